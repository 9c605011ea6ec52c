"""The operators as queries over the generated tables, and the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, licenses, line_dedup, merkle, mixing, near_dedup, packing, pii, secret_scan, spelling, toxicity, wavelet
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op2_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, {AZ.format("coalesce(text, '')")} AS content FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""


@query
def op5_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op5_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE)
         / (0.25::DOUBLE + 0.75::DOUBLE * greatest(0.0::DOUBLE,
             1.0::DOUBLE - abs(length(text)::DOUBLE / greatest(size, 1) - 6.0::DOUBLE) / 6.0::DOUBLE)) AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM keyed GROUP BY source),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here FROM sources),
targets AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, w *
         (SELECT arg_min(level_here, full_at) FROM filled WHERE full_at > level_here)), 2.0::DOUBLE * source_size) AS target FROM filled),
placed AS (
  SELECT k.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN upto - size < target - epochs * source_size
                               AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@query
def op7_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


KEY = AZ.format(r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")
ORACLE["op7_line_dedup"] = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
k AS (SELECT doc_id, line, pos, {KEY} AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op4_wavelet_tokens(spark, sf_dir):
    shards = wavelet.write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return wavelet.read_documents(shards)


@query
def op10_packing(spark, sf_dir):
    sequences = packing.bucketed(packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1))
    return sequences.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_toxicity(spark, sf_dir):
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op3_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query
def op1_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op6_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k, F.col("base")).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.printed(F.col("base")), 256).alias("base_sha256"), pii.printed(F.col("spans")).alias("spans"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, language, and a folder for every hundred ids."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    path = F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(F.floor(F.col("doc_id") / 100)), part(F.col("doc_id")))
    return docs.select(path.alias("path"), "text")


@query
def op8_license_scan(spark, sf_dir):
    found = licenses.scan(as_files(table(spark, sf_dir, "documents")))
    doc_id = F.regexp_extract("path", "[^/]+$", 0).try_cast("long")
    return found.select(doc_id.alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), F.col("source").alias("license_source"), "license_dir")


@query
def op11_secret_scan(spark, sf_dir):
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    base = secret_scan.of_base(F.col("spans"))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.printed(base), 256).alias("base_sha256"), secret_scan.printed(F.col("spans")).alias("spans"))


def either_case(pattern: str) -> str:
    """ASCII letters in either case, spelled out: the engine's own flag also folds other letters."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)


# per rule: the expression, and the one for the part whose length counts
ASSIGN = either_case("(?:password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?"""
SECRET_RULES = [
    (f"{ASSIGN}[A-Za-z0-9+/_.=-]+", ASSIGN),
    ("AKIA[A-Z0-9]+", "AKIA"),
    ("[0-9a-f]+", ""),
    ("gh[opsu]_[A-Za-z0-9]+", "gh[opsu]_"),
    ("xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-"),
    ("AIza[A-Za-z0-9_-]+", "AIza"),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY----"),
]
MATCHED = "\n  UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, '{rule.kind}' AS name, regexp_extract_all(text, '{expression}') AS m, "
    f"string_split_regex(text, '{expression}') AS gaps, '^(?:{head})' AS head, {rule.tail} AS tail FROM t"
    for k, (rule, (expression, head)) in enumerate(zip(secret_scan.RULES, SECRET_RULES))
)
# a match starts after all earlier matches and gaps
ORACLE["op11_secret_scan"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({MATCHED}),
each AS (SELECT doc_id, kind, name, head, tail, unnest(m) AS m, unnest(gaps[:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM matched WHERE len(m) > 0),
placed AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM each),
kept AS (
  SELECT doc_id, kind, name, stop - length(m) AS start, stop FROM placed
  WHERE length(CASE WHEN head = '^(?:)' THEN m ELSE regexp_replace(m, head, '') END) >= tail),
spans AS (SELECT doc_id, kind, start, name || ':' || start || ':' || stop AS span FROM kept)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
       count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM t LEFT JOIN spans ON t.doc_id = spans.doc_id GROUP BY t.doc_id
"""


def misspelled(doc_id, run):
    """A run whose crc32 with its document is divisible by 31 loses the code point that the crc32 names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


@query
def op12_spelling_variants(spark, sf_dir):
    words = spelling.counted_words(table(spark, sf_dir, "documents"), 7, 2, misspelled)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def crc32_sql(blob: str) -> str:
    """Unsigned crc32 of a blob, bit by bit: a byte is mixed in, then eight shifts, written as -1."""
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    byte = f"CAST('0x' || substr(hex({blob}), 2 * k + 1, 2) AS BIGINT)"
    todo = f"flatten(list_transform(range(octet_length({blob})), lambda k: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {todo}), lambda a, x: {step}), 4294967295)"


LOWER = AZ.format("coalesce(text, '')")
ORACLE["op12_spelling_variants"] = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents),
hashed AS (SELECT run, {crc32_sql("encode(id || ':' || run)")} AS h FROM runs),
spelled AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
shorter AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM shorter a JOIN words w ON a.d = w.word
  UNION SELECT w.word, a.word, a.n FROM shorter a JOIN words w ON a.d = w.word),
ranked AS (
  SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN r.near END AS form,
         CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chain AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.onward = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.onward IS NULL
"""


@query
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(docs.withColumn("found", F.when(tampered, F.replace("text", F.lit("\n"), F.lit("")))))


CODED = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
LEAF = "sha256(" + " || ".join(CODED.format(c) for c in merkle.FIELDS[:-1]) + " || {0})"
# per tree: all nodes by level, and the two texts of digests beside each
ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, {LEAF.format(CODED.format("text"))} AS leaf,
         {LEAF.format(CODED.format("replace(text, chr(10), '')"))} AS cut,
         doc_id IS NOT NULL AND {crc32_sql("encode(CAST(doc_id AS VARCHAR))")} % 2 = 0 AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM l),
low AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT source, any_value(lvl) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY source, pos // 3),
heads AS (SELECT source, node AS subroot, lvl AS height FROM low WHERE n = 1),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS spot, count(*) OVER () AS n FROM heads),
high AS (
  SELECT 0 AS lvl, spot AS pos, n, subroot AS node FROM named
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY pos // 3),
beside AS (
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM low a JOIN low b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL),
above AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM high a JOIN high b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
steps AS (
  SELECT p.source, p.pos, s.lvl, s.before, s.after FROM placed p
  JOIN beside s ON p.source IS NOT DISTINCT FROM s.source AND p.pos // CAST(pow(3, s.lvl) AS BIGINT) = s.pos
  UNION ALL
  SELECT p.source, p.pos, h.height + s.lvl, s.before, s.after FROM placed p
  JOIN named h ON p.source IS NOT DISTINCT FROM h.source JOIN above s ON h.spot // CAST(pow(3, s.lvl) AS BIGINT) = s.pos),
proofs AS (SELECT source, pos, sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256, max(lvl) + 1 AS height FROM steps GROUP BY ALL),
folded AS (
  SELECT source, pos, 0 AS lvl, CASE WHEN tampered THEN cut ELSE leaf END AS node FROM placed
  UNION ALL
  SELECT f.source, f.pos, f.lvl + 1, sha256(s.before || f.node || s.after) FROM folded f
  JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.pos = s.pos AND f.lvl = s.lvl),
root AS (SELECT node AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, h.subroot, r.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.root AS verified
FROM placed p JOIN heads h ON p.source IS NOT DISTINCT FROM h.source CROSS JOIN root r
LEFT JOIN proofs q ON p.source IS NOT DISTINCT FROM q.source AND p.pos = q.pos
JOIN folded f ON p.source IS NOT DISTINCT FROM f.source AND p.pos = f.pos AND f.lvl = coalesce(q.height, 0)
"""
