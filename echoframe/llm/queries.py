"""The queries of this subpackage for the driver: one per operator, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, importance, language_model, mixing, near_duplicates, periodic_runs, personal_data, piece_codec, quality, token_counts, token_files, toxicity
from .shared import table


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are more than 4,096."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", 4096)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the plain spans, and all spans."""
    return personal_data.find_all(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from the token files."""
    return token_files.token_output(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 0)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of the benchmark, and the items."""
    return decontaminate.digests(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components by four-word shingles at a similarity of 0.8."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the mixing model, and of a smoothed unigram model, learned from six of seven documents."""
    return language_model.score_documents(table(spark, sf_dir, "documents"), 7, 2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def _scored(scores: DataFrame, mod: int, rest: int) -> DataFrame:
    return scores.select("doc_id", quality.held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four of five labelled rows."""
    return _scored(quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0), 5, 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of three of four rows are used."""
    return _scored(toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2), 4, 2)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    coded = piece_codec.encode_and_decode(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", packed=True)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy score and rank of every document in a draw of 5 % towards the benchmark's distribution."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All periodic runs of 12 words or more of every document, some with a planted one: their number, the longest one, digests."""
    found = periodic_runs.collapse_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")), 12)
    d = found.withColumn("top", periodic_runs.longest(F.col("runs"))).withColumn("length", -F.col("top.length"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), "length", F.col("top.period").alias("period"),
        F.expr("length * 1000 div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_model, op2_mixing, op3_token_counts, op4_personal_data, op5_token_output, op6_benchmark_decontamination, op7_minhash_near_dedup, op8_fingerprints, op9_quality_classifier, op10_toxicity, op11_piece_codec, op12_importance_resampling, op13_periodic_runs)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 in SQL: its table from the reversed polynomial, and the value of a list of bytes.
_CRC_TABLE = "t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT UNNEST(range(256)) AS i))"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295)"


#: Whole tables in plain SQL; the other operators are trained, random or need a library, and are tested against brute force.
SQL: dict[str, str] = {
    "op6_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT row_number() OVER () AS item, item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT item, item_id, n, j, array_to_string(w[j : j + n - 1], ' ') AS g FROM (SELECT *, UNNEST(range(1, len(w) - n + 2)) AS j FROM s)),
places AS (SELECT doc_id, n, w, UNNEST(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.k, p.n, v.item, v.item_id, v.j FROM places p JOIN windows v ON v.n = p.n AND v.g = array_to_string(p.w[p.k : p.k + p.n - 1], ' ')),
hit_words AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, UNNEST(range(k, k + n)) AS pos FROM hits)),
sides AS (SELECT doc_id, item, n, k - j AS side, k - row_number() OVER (PARTITION BY doc_id, item, k - j ORDER BY k) AS run FROM hits),
runs AS (SELECT doc_id, count(*) + min(n) - 1 AS length FROM sides GROUP BY doc_id, item, side, run),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce((SELECT count(*) FROM hit_words h WHERE h.doc_id = d.doc_id), 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
sha256(coalesce(items.i, '')) AS items_sha256, items.n IS NOT NULL AS contaminated, coalesce((SELECT max(length) FROM runs r WHERE r.doc_id = d.doc_id), 0)::BIGINT AS longest_match
FROM d LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op7_minhash_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 2, 2))) AS k FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.m AS component_id, g.m = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(m) AS m FROM r GROUP BY v) g ON g.v = d.doc_id""",
    "op12_importance_resampling": f"""
WITH {_CRC_TABLE},
a AS (SELECT true AS own, row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
UNION ALL SELECT false, row_number() OVER (), NULL, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT own, r, array_to_string(w[j : j + k - 1], ' ') AS f FROM (SELECT own, r, w, k, UNNEST(range(1, len(w) - k + 2)) AS j FROM a, (VALUES (1), (2), (3)) v(k) WHERE len(w) >= k)),
e AS (SELECT f, {_crc("list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT)")} % 10000 AS b FROM (SELECT DISTINCT f FROM f), t),
c AS (SELECT own, r, b, count(*) AS n FROM f JOIN e USING (f) GROUP BY ALL),
s AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM c GROUP BY b),
z AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM s),
g AS (SELECT b, floor(1000 * ln(((s.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE) / ((s.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE)))::BIGINT AS gain FROM s, z),
w AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM c JOIN g USING (b) WHERE own GROUP BY r),
d AS (SELECT a.r, doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM a LEFT JOIN w USING (r) WHERE own),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM d WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END::BIGINT AS rank FROM d LEFT JOIN k USING (r)""",
    "op13_periodic_runs": f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} AS h FROM documents, t),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 % greatest(len(w), 1) AS a, 3 + h // 10 % 8 AS k FROM d),
v AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // k) + 1])) ELSE w END AS w FROM g),
u AS (SELECT doc_id, n, UNNEST(range(n)) AS i, UNNEST(w) AS word FROM v),
m AS (SELECT x.doc_id, y.i - x.i AS p, x.i FROM u x JOIN u y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND y.i - x.i <= x.n // 2),
s AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS side FROM m),
f AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM s GROUP BY doc_id, p, side HAVING count(*) + p >= greatest(12, 2 * p)),
r AS (SELECT doc_id, start, length, min(p) AS period FROM f GROUP BY doc_id, start, length),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min([start, length, period], [-length, start, period]) AS top, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, UNNEST(range(start + period, start + length)) AS i FROM r),
c AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN x ON x.doc_id = u.doc_id AND x.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top[1]::BIGINT AS start, top[2]::BIGINT AS length, top[3]::BIGINT AS period, (top[2] * 1000 // top[3])::BIGINT AS exponent_milli,
sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
}
