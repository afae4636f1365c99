"""The registered queries of this package, and the same results in plain SQL where SQL can give them.

Each query is thin: it applies an operator to its whole table and derives the columns that can be
compared from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    embeddings, exactdup, language, lmscore, manifest, mixing, neardup, packing, pii, quality, search, toxicity, windows,
)
from .shared import in_fold

TOKENIZER = "word_bpe_49k.json"


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _load(spark, sf_dir, "documents"), _load(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = quality.fit_quality(docs, labels.where(~held_out))
    return quality.quality_scores(docs, model).withColumn("held_out", held_out)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = language.fit_language(docs.where(~held_out))
    return language.languages_of(docs, model).withColumn("held_out", held_out)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_copies(_load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_load(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.fit_pii(docs))
    base = F.filter("spans", lambda s: s["by_rule"])

    def of_kind(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id", *[of_kind(k) for k in pii.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _load(spark, sf_dir, "documents"), _load(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = toxicity.fit_toxicity(docs, labels.where(~held_out))
    found = toxicity.toxic_spans(docs, model).withColumn("held_out", held_out)
    offsets = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select("doc_id", "held_out", "score", "predicted", F.array_join(offsets, ",").alias("offsets"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(_load(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_load(spark, sf_dir, "embeddings"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    model = lmscore.fit_difference(_load(spark, sf_dir, "benchmark"), docs)
    return lmscore.difference_scores(docs, model)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(_load(spark, sf_dir, "documents"), tokenizer_path())


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents")
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = manifest.digest([more if c == "n_chars" else F.col(c) for c in values])
    made = manifest.merkle_manifest(docs.select(*values, tampered.alias("tampered")), value_cols=values, carry=["tampered"])
    leaf = F.when(in_fold(F.col("doc_id"), 7, 0), F.col("tampered")).otherwise(F.col("leaf"))
    made = made.withColumn("folded_root", manifest.folded(leaf, F.col("steps")))
    siblings = F.array_join(F.transform("steps", lambda s: s["sibling"]), "")
    return made.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"))


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.packed_windows(_load(spark, sf_dir, "documents"), tokenizer_path())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_quality, op2_language, op3_mixing, op4_minhash, op5_pii, op6_toxicity, op7_exact, op8_embeddings, op9_lm_score,
        op10_packing, op11_manifest, op12_search, op13_windows, pipeline,
    )
}

_EXACT = r"""
WITH texts AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM texts
"""

_NEAR = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN lowest ON doc_id = a
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


_FIELDS = "sha256({} || {} || {} || {} || {})"
# The remainder of a polynomial division, bit by bit, over the digits of the id.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                             lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

_MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_FIELDS.format(*map(_field, ("doc_id", "source", "lang", "n_chars", "text")))} AS leaf,
           {_FIELDS.format(*map(_field, ("doc_id", "source", "lang")), _field("(n_chars + 1)"), _field("text"))} AS tampered,
           coalesce({_CRC32} % 7 = 0, false) AS hit
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
    GROUP BY tree, level, pos // 2
), subroots AS (SELECT tree, max(level) AS height, arg_max(h, level) AS subroot FROM nodes GROUP BY tree
), tops AS (
    SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1
    GROUP BY level, pos // 2
), whole AS (SELECT max(level) AS height, arg_max(h, level) AS root FROM tops
), floors AS (SELECT unnest(range(0, 64)) AS level
), steps AS (
    SELECT p.doc_id, floors.level AS step, b.h AS sibling, (p.pos >> floors.level) & 1 = 1 AS on_left
    FROM placed p JOIN subroots s USING (tree) JOIN floors ON floors.level < s.height
    LEFT JOIN nodes b ON b.tree = p.tree AND b.level = floors.level AND b.pos = xor(p.pos >> floors.level, 1)
    UNION ALL
    SELECT p.doc_id, 100 + floors.level, b.h, (p.tree >> floors.level) & 1 = 1
    FROM placed p JOIN whole w ON true JOIN floors ON floors.level < w.height
    LEFT JOIN tops b ON b.level = floors.level AND b.pos = xor(p.tree >> floors.level, 1)
), paths AS (
    SELECT doc_id, coalesce(string_agg(sibling, '' ORDER BY step), '') AS siblings,
           list({{'s': coalesce(sibling, ''), 'l': on_left}} ORDER BY step) AS steps
    FROM steps GROUP BY doc_id
), folding AS (
    SELECT doc_id, 1 AS k, CASE WHEN hit AND tampered IS NOT NULL THEN tampered ELSE leaf END AS h,
           coalesce(steps, []) AS steps FROM placed LEFT JOIN paths USING (doc_id)
    UNION ALL
    SELECT doc_id, k + 1, sha256(CASE WHEN steps[k].l THEN steps[k].s || h ELSE h || steps[k].s END), steps
    FROM folding WHERE k <= len(steps)
), ends AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM folding GROUP BY doc_id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (tree) JOIN whole ON true JOIN ends USING (doc_id) LEFT JOIN paths USING (doc_id)
"""

_SEARCH = rf"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes
), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total
    GROUP BY item_id, doc_id
), placed AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op7_exact": _EXACT, "op4_minhash": _NEAR, "op11_manifest": _MANIFEST, "op12_search": _SEARCH,
}
