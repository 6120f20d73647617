"""The queries over the synthetic tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import align, bpe, decontaminate, gbdt, langid, phrases, pii, rules, simhash, substring, suffixes, toxic, warc
from crosspanel.llm._rows import documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back (``warc.archive`` says what nulls, repeats and empty tables give)."""
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that an earlier 100-byte string covers, for every document (``suffixes.remove_earlier``)."""
    return suffixes.remove_earlier(documents(spark, sf_dir)).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item within the item's edit budget (``decontaminate.contaminated``)."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests (``bpe.round_trip``)."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document (``rules.quality_rules``)."""
    return rules.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document; a null id is not held out (``gbdt.score_quality``)."""
    docs = documents(spark, sf_dir)
    trees = gbdt.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gbdt.score_quality(docs, trees).select("doc_id", gbdt.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a repeated window of 35 words covers, for every document (``substring.remove_repeats``)."""
    return substring.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a null id is not held out (``langid.predict_languages``)."""
    docs = documents(spark, sf_dir)
    found = langid.predict_languages(docs, langid.fit_languages(docs))
    return found.select("doc_id", gbdt.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def _of_kind(spans: str, kind: str) -> Column:
    """How many of the comma-joined spans are of a kind.  The lambda takes one argument: Spark would fill a second with the index."""
    return F.size(F.filter(F.split(spans, ","), lambda x: x.startswith(f"{kind}:"))).cast("long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, counted by kind; n_spans counts all, those of the contexts too (``pii.private_spans``)."""
    found = pii.private_spans(documents(spark, sf_dir))
    counts = [_of_kind("base", k).alias(f"n_{k}") for k in pii.KINDS[:4]]
    n = F.when(F.length("spans") > 0, F.size(F.split("spans", ","))).otherwise(0).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", n)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (``simhash.near_duplicates``)."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document by two tokenizers, aligned by bytes (``align.align_tokens``)."""
    import public_tokenizers

    return align.align_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language over all documents (``phrases.collocations``)."""
    return phrases.collocations(documents(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document; a null id is not held out (``toxic.score_toxicity``)."""
    docs = documents(spark, sf_dir)
    model = toxic.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic.score_toxicity(docs, model).select("doc_id", gbdt.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


_ALL = (
    op1_warc, op2_suffix_array, op3_decontamination, op4_bpe, op5_quality_rules, op6_quality_classifier, op7_pii, op8_difference_cover,
    op9_language_id, op10_simhash, op11_alignment, op12_collocations, op13_toxicity,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), t AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
        SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top > page_id THEN top END AS refers_to FROM t""",
    "op8_difference_cover": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        c AS (SELECT win FROM s GROUP BY 1 HAVING count(*) > 1),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM s SEMI JOIN c USING (win)),
        g AS (SELECT doc_id, list(j) AS gone, count(*) FILTER (NOT follows) AS n_spans FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) IS NOT DISTINCT FROM j - 1 AS follows FROM r) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op12_collocations": r"""WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
        g AS (SELECT lang, k, w[i:i + k - 1] AS ws FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
        n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
        f AS (SELECT lang, k, ws, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
        cut AS (SELECT lang, ws, f AS a, c, ws[1:c] AS x, ws[c + 1:] AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
        cs AS (SELECT cut.lang, cut.ws, a, c, fl.f AS l, fr.f AS r, (2000000::HUGEINT * a) // (fl.f + fr.f) AS score
          FROM cut JOIN f fl ON fl.lang = cut.lang AND fl.ws = x JOIN f fr ON fr.lang = cut.lang AND fr.ws = y),
        best AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, c) = 1),
        sub AS (SELECT lang, ws[i:i + s - 1] AS ws, max(f) AS longer FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM f WHERE k > 2)) GROUP BY 1, 2)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM (SELECT best.*, array_to_string(best.ws, ' ') AS phrase, n FROM best JOIN n USING (lang) LEFT JOIN sub ON sub.lang = best.lang AND sub.ws = best.ws WHERE longer IS NULL OR 100 * longer < 80 * a)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
