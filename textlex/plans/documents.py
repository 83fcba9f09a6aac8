"""Queries on the documents table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlex.functions import text as T
from textlex.operators import corpus, frequency, ngrams
from textlex.plans.inline import BROKEN, REGISTRY

LEXICON_DOCUMENTS = 3  # a word of at least so many documents is in the lexicon

SEP = T.SEPARATORS
WS = T.WHITE_SPACE
SQL_WORDS = f"list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '{SEP}'), lambda w: regexp_matches(w, '\\p{{L}}'))"
SQL_TRIM = f"^[{WS}]+|[{WS}]+$"
DOCS = "docs AS (SELECT source AS corpus_id, CAST(doc_id AS VARCHAR) AS document_id, text, lang FROM documents)"
WORDS = f"words AS (SELECT corpus_id, document_id, lang, unnest({SQL_WORDS}) AS word FROM docs)"
FREQ = f"""{DOCS}, {WORDS}, total AS (SELECT count(*) AS total FROM words), freq AS (
  SELECT word, count(*) AS token_count, count(DISTINCT document_id) AS document_count,
         round(count(*) / max(total), 12) AS normalized_frequency, round(log10(count(*) / max(total) * 1e9) * 100) / 100 AS zipf
  FROM words, total GROUP BY word)"""
SENTENCES = f"""{DOCS}, pieces AS (
  SELECT corpus_id, document_id, lang,
         list_filter(list_transform(regexp_extract_all(text, '{T.SENTENCE}'), lambda p: regexp_replace(p, '{SQL_TRIM}', '', 'g')),
                     lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')) AS s FROM docs)"""
DOC_KEY = f"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '(?m)[{WS.replace(chr(92) + 'x{9}-' + chr(92) + 'x{D}', chr(92) + 'x{9}' + chr(92) + 'x{B}-' + chr(92) + 'x{D}')}]+$', '', 'g'), '^\\n+|\\n+$', '', 'g')"
SENTENCE_KEY = f"regexp_replace(regexp_replace(lower(nfc_normalize(s)), '[{WS}]+', ' ', 'g'), '{SQL_TRIM}', '', 'g')"
TOKEN_CLASS = """CASE WHEN regexp_matches(word, '://|^www\\.|@.+\\.') THEN 'url_or_email' WHEN regexp_matches(word, '^[\\p{N}.,]+$') THEN 'numeric'
  WHEN contains(word, chr(65533)) THEN 'replacement' WHEN regexp_matches(word, '\\p{Cc}') THEN 'control'
  WHEN regexp_matches(word, '[\\p{Arabic}\\p{Cyrillic}]') THEN 'arabic_or_cyrillic' ELSE 'latin' END"""
PARTITION = "CAST(('0x' || substr(sha256('" + corpus.PARTITION_TAG + "' || chr(0) || g), 1, 16)) AS UBIGINT) % 100"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Inputs up to this many bytes, in fewer files than cores, are dealt to all cores before the texts are worked on: a small file may be a single split.
SMALL_INPUT = 1 << 30


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table of few files in as many parts as there are cores; larger ones have splits enough and aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores, key) if size <= SMALL_INPUT and len(df.inputFiles()) < cores else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.canonical(spread(read(spark, sf_dir, "documents").select("source", "doc_id", "text", "lang"), "doc_id"))


def freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.word_frequencies(docs(spark, sf_dir))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, token_count, document_count, zipf of the words of several documents."""
    return freq(spark, sf_dir).filter(F.col("document_count") >= LEXICON_DOCUMENTS)


LEXICON = f"{FREQ}, lexicon AS (SELECT * FROM freq WHERE document_count >= {LEXICON_DOCUMENTS})"


def registry(spark):
    return REGISTRY.frame(spark)


def sentence_rows(spark, sf_dir):
    d = docs(spark, sf_dir).select("document_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))
    return d.select("document_id", F.col("place").cast("long").alias("place"), "sentence", T.sentence_key(F.col("sentence")).alias("sentence_key"))


def _forms(words):
    word = F.upper("word")
    return words.select(word.alias("display"), T.normalize(word).alias("normalized"), T.strip_diacritics(word).alias("stripped"), T.normalize_text(F.concat(F.lit("​"), word)).alias("clean"))


def normal_forms(spark, sf_dir):
    """Different words with a letter beyond ASCII; without ß, whose capital differs between engines, so that SQL can follow."""
    return _forms(freq(spark, sf_dir).filter(F.col("word").rlike(r"[^\x{0}-\x{7F}]") & ~F.col("word").contains("ß")))


def normal_forms_all(spark, sf_dir):
    """All different words."""
    return _forms(freq(spark, sf_dir))


def _gram_queries() -> tuple[dict, dict]:
    q, sql = {}, {}
    for n, name in ((2, "bigram"), (3, "trigram")):
        ctx = ngrams.CONTEXT[n]
        keys = ", ".join(ctx)
        run = ", ".join(f"w[i + {k}] AS {c}" for k, c in enumerate([*ctx, "next"]))
        words = SQL_WORDS.replace("(text)", "(s)")
        raw = f"""{SENTENCES}, toks AS (SELECT {words} AS w FROM (SELECT unnest(s) AS s FROM pieces)),
          runs AS (SELECT {run} FROM (SELECT w, unnest(range(1, len(w) - {n} + 2)) AS i FROM toks WHERE len(w) >= {n})),
          counts AS (SELECT {keys}, next, count(*) AS count FROM runs GROUP BY ALL),
          raw AS (SELECT *, sum(count) OVER (PARTITION BY {keys})::BIGINT AS context_count FROM counts),
          model AS (SELECT *, (count * 1000000 + context_count // 2) // context_count AS probability_millionths FROM raw WHERE count >= 2),
          ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY probability_millionths DESC, count DESC, next) AS rank FROM model)"""
        q[f"{name}s"] = lambda s, d, n=n: ngrams.model(docs(s, d), n)
        sql[f"{name}s"] = f"WITH {raw} SELECT * FROM model"
        q[f"{name}_topk"] = lambda s, d, n=n: ngrams.top_per_context(ngrams.model(docs(s, d), n), n)
        sql[f"{name}_topk"] = f"WITH {raw} SELECT * FROM ranked WHERE rank <= {ngrams.TOP[n]}"
        q[f"top_{name}s"] = lambda s, d, n=n: ngrams.most_frequent(ngrams.model(docs(s, d), n), n)
        sql[f"top_{name}s"] = f"WITH {raw} SELECT * FROM model ORDER BY count DESC, {keys}, next LIMIT 50"
        q[f"{name}_contexts"] = lambda s, d, n=n: ngrams.context_distribution(ngrams.model(docs(s, d), n), n)
        sql[f"{name}_contexts"] = f"WITH {raw} SELECT predictions, count(*) AS contexts FROM (SELECT {keys}, count(*) AS predictions FROM model GROUP BY {keys}) GROUP BY 1"
        q[f"{name}_summary"] = lambda s, d, n=n: ngrams.summary(docs(s, d), n)
        sql[f"{name}_summary"] = f"""WITH {raw} SELECT (SELECT sum(count)::BIGINT FROM raw) AS windows, (SELECT count(*) FROM raw) AS raw_distinct,
          (SELECT count(*) FROM model) AS pruned_distinct, (SELECT count(*) FROM raw WHERE count < 2) AS count_pruned,
          (SELECT sum(len(s))::BIGINT FROM pieces) AS sentences, (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM model)) AS contexts, (SELECT count(*) FROM ranked WHERE rank > {ngrams.TOP[n]}) AS capacity_pruned"""
        q[f"{name}_oov"] = lambda s, d, n=n: ngrams.oov_summary(ngrams.model(docs(s, d), n), lexicon(s, d), n)
        flags = {c: f"{c} NOT IN (SELECT word FROM lexicon)" for c in [*ctx, "next"]}
        sql[f"{name}_oov"] = (
            f"WITH {LEXICON}, {raw.replace(DOCS + ', ', '', 1)} SELECT "
            + ", ".join(f"count(*) FILTER ({f}) AS oov_{c}" for c, f in flags.items())
            + f", count(*) FILTER (NOT ({' OR '.join(flags.values())})) AS eligible, count(*) AS runs FROM model"
        )
        q[f"{name}_violations"] = lambda s, d, n=n: ngrams.violations(ngrams.model(docs(s, d), n), n)
        sql[f"{name}_violations"] = f"WITH {raw}, again AS (SELECT *, count(*) OVER (PARTITION BY {keys}, next) AS again FROM model) SELECT * EXCLUDE (again) FROM again WHERE count <= 0 OR context_count <= 0 OR count > context_count OR probability_millionths NOT BETWEEN 1 AND 1000000 OR again > 1"
        keyed = BROKEN[n]
        q[f"{name}_violations_inline"] = lambda s, d, n=n: ngrams.violations(BROKEN[n].frame(s), n)
        sql[f"{name}_violations_inline"] = sql[f"{name}_violations"].replace(f"WITH {raw}", f"WITH {keyed.sql}").replace("FROM model)", f"FROM {keyed.name})")
    return q, sql


QUERIES = {
    "word_frequency": freq,
    "top_words": lambda s, d: frequency.ranked(freq(s, d), 100),
    "freq_summary": lambda s, d: frequency.summary(freq(s, d)),
    "zipf_buckets": lambda s, d: frequency.zipf_buckets(freq(s, d)),
    "length_distribution": lambda s, d: frequency.length_distribution(freq(s, d)),
    "char_analysis": lambda s, d: frequency.char_analysis(freq(s, d)),
    "coverage_milestones": lambda s, d: frequency.coverage_milestones(freq(s, d)),
    "sentences": sentence_rows,
    "normal_forms": normal_forms,
    "normal_forms_all": normal_forms_all,
    "token_classes": lambda s, d: corpus.token_classes(docs(s, d)),
    "doc_dedup_groups": lambda s, d: corpus.document_duplicates(docs(s, d)),
    "sentence_dups": lambda s, d: corpus.sentence_duplicates(docs(s, d)),
    "partition_docs": lambda s, d: corpus.partition_documents(docs(s, d)),
    "partition_leakage": lambda s, d: corpus.leakage(corpus.partition_documents(docs(s, d))),
    "partition_groups": lambda s, d: corpus.partition_documents(docs(s, d)).groupBy("partition").agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("duplicate_group_id").alias("groups")),
    "inventory": lambda s, d: corpus.inventory(docs(s, d)),
    "token_totals": lambda s, d: corpus.token_totals(docs(s, d)),
    "corpus_quality": lambda s, d: corpus.quality(docs(s, d), least_documents=LEXICON_DOCUMENTS),
    "token_breakdown": lambda s, d: corpus.breakdown(docs(s, d), registry(s)),
}
KEYED = f"{DOCS}, keyed AS (SELECT corpus_id, document_id, sha256({DOC_KEY}) AS g FROM docs)"
ORACLE = {
    "word_frequency": f"WITH {FREQ} SELECT * FROM freq",
    "top_words": f"WITH {FREQ} SELECT * FROM freq ORDER BY token_count DESC, word LIMIT 100",
    "freq_summary": f"""WITH {FREQ} SELECT count(*) AS vocabulary, count(*) FILTER (token_count = 1) AS hapax, max(token_count) AS largest,
      round(avg(token_count), 4) AS mean, median(token_count) AS median FROM freq""",
    "zipf_buckets": f"WITH {FREQ} SELECT floor(zipf)::BIGINT AS bucket, count(*) AS words FROM freq GROUP BY 1",
    "length_distribution": f"""WITH {FREQ}, l AS (SELECT length(word)::BIGINT AS length, sum(token_count)::BIGINT AS tokens FROM freq GROUP BY 1),
      r AS (SELECT *, sum(tokens) OVER (ORDER BY length) AS upto, sum(tokens) OVER () AS total, sum(tokens * length) OVER () AS mass FROM l)
      SELECT length, tokens, round(mass / total, 4) AS mean, (SELECT min(length) FROM r WHERE upto > (total - 1) // 2) AS median FROM r""",
    "char_analysis": f"""WITH {FREQ}, c AS (SELECT word, token_count, unnest(string_split(word, '')) AS char FROM freq)
      SELECT char, printf('U+%04X', unicode(char)) AS code_point, sum(token_count)::BIGINT AS occurrences, count(DISTINCT word) AS words FROM c GROUP BY char""",
    "coverage_milestones": f"""WITH {FREQ}, r AS (SELECT row_number() OVER o AS rank, sum(token_count) OVER o AS mass, sum(token_count) OVER () AS total
      FROM freq WINDOW o AS (ORDER BY token_count DESC, word ROWS UNBOUNDED PRECEDING))
      SELECT percent, min(rank) AS rank FROM r, (SELECT unnest({frequency.MILESTONES}) AS percent) WHERE mass * 100 >= total * percent GROUP BY percent""",
    "sentences": f"""WITH {SENTENCES}, each AS (SELECT document_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS place FROM pieces)
      SELECT document_id, place, s AS sentence, {SENTENCE_KEY} AS sentence_key FROM each""",
    "normal_forms": f"""WITH {FREQ} SELECT upper(word) AS display, lower(nfc_normalize(upper(word))) AS normalized,
      translate(lower(nfc_normalize(upper(word))), '{T.MARKED}', '{T.PLAIN}') AS stripped, lower(nfc_normalize(upper(word))) AS clean
      FROM freq WHERE regexp_matches(word, '[^\\x00-\\x7F]') AND NOT contains(word, 'ß')""",
    "token_classes": f"WITH {DOCS}, {WORDS} SELECT {TOKEN_CLASS} AS class, count(*) AS tokens, count(DISTINCT word) AS words FROM words GROUP BY 1",
    "doc_dedup_groups": f"""WITH {KEYED} SELECT g AS duplicate_group_id, count(*) AS n, min((corpus_id, document_id))[1] AS corpus_id, min((corpus_id, document_id))[2] AS document_id
      FROM keyed GROUP BY g HAVING count(*) > 1""",
    "sentence_dups": f"""WITH {SENTENCES}, each AS (SELECT document_id, unnest(s) AS s FROM pieces), k AS (SELECT document_id, {SENTENCE_KEY} AS k FROM each)
      SELECT sha256(k) AS sentence_id, count(*) AS n, min(document_id) AS document_id FROM k GROUP BY k HAVING count(*) > 1""",
    "partition_docs": f"""WITH {KEYED} SELECT CASE WHEN {PARTITION} < 80 THEN 'train' WHEN {PARTITION} < 90 THEN 'development' ELSE 'evaluation' END AS partition,
      corpus_id, document_id, g AS duplicate_group_id, count(*) OVER w > 1 AS is_duplicate,
      first_value(corpus_id) OVER w2 AS canonical_corpus_id, first_value(document_id) OVER w2 AS canonical_document_id
      FROM keyed WINDOW w AS (PARTITION BY g), w2 AS (PARTITION BY g ORDER BY corpus_id, document_id)""",
    "partition_leakage": f"""WITH {KEYED}, p AS (SELECT g, CASE WHEN {PARTITION} < 80 THEN 'train' WHEN {PARTITION} < 90 THEN 'development' ELSE 'evaluation' END AS partition FROM keyed)
      SELECT g AS duplicate_group_id, count(DISTINCT partition) AS partitions FROM p GROUP BY 1 HAVING count(DISTINCT partition) > 1""",
    "partition_groups": f"""WITH {KEYED}, p AS (SELECT g, document_id, CASE WHEN {PARTITION} < 80 THEN 'train' WHEN {PARTITION} < 90 THEN 'development' ELSE 'evaluation' END AS partition FROM keyed)
      SELECT partition, count(*) AS documents, count(DISTINCT g) AS groups FROM p GROUP BY 1""",
    "inventory": f"""WITH {SENTENCES}, {WORDS} SELECT corpus_id, d.documents, d.sentences, w.tokens, w.distinct_tokens FROM
      (SELECT corpus_id, count(*) AS documents, sum(len(s))::BIGINT AS sentences FROM pieces GROUP BY 1) d
      JOIN (SELECT corpus_id, count(*) AS tokens, count(DISTINCT word) AS distinct_tokens FROM words GROUP BY 1) w USING (corpus_id)""",
    "token_totals": f"WITH {DOCS}, {WORDS} SELECT lang, corpus_id, count(*) AS tokens FROM words GROUP BY ROLLUP (lang, corpus_id)",
    "corpus_quality": f"""WITH {LEXICON}, c AS (SELECT corpus_id, {TOKEN_CLASS} AS class, word IN (SELECT word FROM lexicon) AS known FROM words),
      keyed AS (SELECT corpus_id, document_id, row_number() OVER (PARTITION BY sha256({DOC_KEY}) ORDER BY corpus_id, document_id) AS k FROM docs)
      SELECT a.corpus_id, tokens, known_tokens, latin_tokens, other_tokens, duplicate_members FROM
      (SELECT corpus_id, count(*) AS tokens, count(*) FILTER (known) AS known_tokens, count(*) FILTER (class = 'latin') AS latin_tokens,
              count(*) FILTER (class <> 'latin') AS other_tokens FROM c GROUP BY ROLLUP (corpus_id)) a
      LEFT JOIN (SELECT corpus_id, count(*) FILTER (k > 1) AS duplicate_members FROM keyed GROUP BY ROLLUP (corpus_id)) b ON a.corpus_id IS NOT DISTINCT FROM b.corpus_id""",
    "token_breakdown": f"""WITH {DOCS}, {WORDS}, {REGISTRY.sql}, w AS (SELECT license, CASE WHEN contains(notes, 'dialogue') OR contains(corpus_name, 'Dialogue') THEN 'dialogue' ELSE 'prose' END AS domain
      FROM words JOIN registry USING (corpus_id)) SELECT 'license' AS kind, license AS name, count(*) AS tokens FROM w GROUP BY 2 UNION ALL SELECT 'domain', domain, count(*) FROM w GROUP BY 2""",
}
_q, _s = _gram_queries()
QUERIES |= _q
ORACLE |= _s
