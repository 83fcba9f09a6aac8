"""Queries on lexicons: search, prediction, import and audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlex.functions import distance as D
from textlex.functions import text as T
from textlex.operators import audit, lexicon, ngrams, predict, search
from textlex.plans import documents as P
from textlex.plans.inline import ASKED, ENTRIES, LINES, RECORDS, SEED

WS = T.WHITE_SPACE


def benchmark_words(spark, sf_dir):
    return P.read(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("query")).distinct()


def search_lexicon(spark, sf_dir):
    lex = P.lexicon(spark, sf_dir)
    return lex.select("word", F.col("word").alias("normalized"), "token_count", "document_count", F.round(F.col("zipf") * 1000).cast("long").alias("zipf_milli"))


ASK = f"ask AS (SELECT DISTINCT unnest({P.SQL_WORDS}) AS query FROM benchmark)"
LEX = P.LEXICON + ", " + ASK
PLAIN = lambda c: f"translate({c}, '{T.MARKED}', '{T.PLAIN}')"


def prefixes(spark, sf_dir):
    """Entries that begin with the first four letters of a benchmark word."""
    q = search.prepared(benchmark_words(spark, sf_dir).select(F.substring("query", 1, 4).alias("query")))
    return search.prefix_matches(q, search_lexicon(spark, sf_dir)).select("query", "word")


def restored(spark, sf_dir):
    plain = search_lexicon(spark, sf_dir).select(F.translate("word", T.MARKED, T.PLAIN).alias("query"))
    return search.diacritic_matches(search.prepared(plain), search_lexicon(spark, sf_dir)).select("query", "word")


def edits(spark, sf_dir):
    found = search.edit_matches(search.prepared(benchmark_words(spark, sf_dir)), search_lexicon(spark, sf_dir))
    return found.select("query", "word", F.col("quarters").cast("long").alias("quarters"), D.edit_cost(F.col("quarters")).alias("edit_cost"))


def suggestions(spark, sf_dir):
    return search.suggest(benchmark_words(spark, sf_dir), search_lexicon(spark, sf_dir), 10)


def seed_suggestions(spark, sf_dir):
    return search.suggest(ASKED.frame(spark), SEED.frame(spark), 10)


def _cost(pairs, cost: int) -> str:
    return f"WHEN list_contains({sorted(pairs)}, a[i] || b[e[1]]) THEN {cost}"


def _bytes(c: str) -> str:
    """Plain letters with a byte for each, as the SQL function counts bytes; marks stand in for letters beyond ASCII, as words have none."""
    return f"translate({PLAIN(c)}, 'àáâäãéèëïíìóòôöõúùüñßœæÿ', '!#$%&()*+,-./:;<=>?@[]^_')"


def edits_sql(queries: str, lexicon: str) -> str:
    """CTEs up to `edited` (query, q, word, normalized, quarters) for queries (query) and a lexicon (word, normalized): the table of distances row by row."""
    change = f"(CASE WHEN a[i] = b[e[1]] THEN 0 {_cost(D.QUARTER, 1)} {_cost(D.NEAR, 3)} ELSE {D.FAR} END)"
    cell = f"least(acc[-1] + {D.GAP}, now[e[1] + 1] + {D.GAP}, now[e[1]] + {change}, CASE WHEN i > 1 AND e[1] > 1 AND a[i] = b[e[1] - 1] AND a[i - 1] = b[e[1]] THEN last[e[1] - 1] + {D.SWAP} ELSE 1000000 END)"
    return f"""pq AS (SELECT DISTINCT query, lower(nfc_normalize(query)) AS q FROM {queries} WHERE query <> ''),
      near AS (SELECT query, q, word, normalized, string_split(q, '') AS a, string_split(normalized, '') AS b FROM pq JOIN {lexicon} ON abs(length(q) - length(normalized)) <= {search.LENGTH_BAND}
        AND damerau_levenshtein({_bytes('q')}, {_bytes('normalized')}) <= 2 AND ({PLAIN('q')} <> {PLAIN('normalized')} OR q = normalized)),
      steps AS (SELECT query, q, word, normalized, a, b, 0 AS i, []::INT[] AS last, list_transform(range(0, len(b) + 1), lambda j: (j * {D.GAP})::INT) AS now FROM near UNION ALL
        SELECT query, q, word, normalized, a, b, i, now, list_reduce(list_prepend([(i * {D.GAP})::INT], list_transform(range(1, len(b) + 1), lambda j: [j::INT])), lambda acc, e: list_append(acc, ({cell})::INT))
        FROM (SELECT * REPLACE (i + 1 AS i) FROM steps WHERE i < len(a))),
      edited AS (SELECT query, q, word, normalized, now[-1]::BIGINT AS quarters FROM steps WHERE i = len(a) AND now[-1] <= {search.MAX_QUARTERS})"""


def suggest_sql(queries: str, lexicon: str) -> str:
    """CTEs up to the ranked suggestions; lexicon: word, normalized, token_count, document_count, zipf_milli, as a table with unique normalized forms."""
    same = f"{PLAIN('normalized')} = {PLAIN('q')}"
    columns = "query, q, l.word, l.normalized, token_count, document_count, zipf_milli"
    keys = f"""list_position({list(search.KINDS)}, kind), CASE WHEN kind = 'Completion' THEN -prefix_quality ELSE edit_cost END, CASE WHEN kind <> 'Completion' AND diacritic THEN 0 ELSE 1 END,
      zipf_milli DESC, document_count DESC, CASE WHEN kind = 'Completion' THEN length(word) ELSE 0 END, word"""
    bonus = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in search.KINDS.items()) + " END"
    alike = f"({PLAIN('lower(word)')} = {PLAIN('q')} AND length(word) = length(q))"
    return f"""{edits_sql(queries, lexicon)}, merged AS (
      SELECT {columns}, CASE WHEN l.normalized = q THEN 'Exact' ELSE 'Completion' END AS kind, CASE WHEN l.normalized = q THEN 0 ELSE 1 END AS edit_cost, {same} AS diacritic, CASE WHEN l.normalized = q THEN {search.EXACT_QUALITY} ELSE length(q) END AS prefix_quality, 1 AS step
        FROM pq JOIN {lexicon} l ON starts_with(l.normalized, q) UNION ALL
      SELECT {columns}, 'DiacriticCorrection', 0, true, 0, 0 FROM pq JOIN {lexicon} l ON {same} AND l.normalized <> q UNION ALL
      SELECT {columns.replace('query, q', 'e.query, e.q')}, CASE WHEN l.normalized = q THEN 'Exact' WHEN starts_with(l.normalized, q) THEN 'Completion' ELSE 'Correction' END, CASE WHEN l.normalized = q THEN 0 ELSE (quarters * 5 + 1) // 2 END, {same.replace('normalized', 'l.normalized')},
        CASE WHEN starts_with(l.normalized, q) THEN length(q) ELSE 0 END, 2 FROM edited e JOIN {lexicon} l ON l.normalized = e.normalized AND l.word = e.word),
      best AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY query, normalized ORDER BY CASE WHEN step = 0 THEN 0 ELSE 1 END, {keys}, step) = 1),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {keys}) AS rank FROM best)
      SELECT query, rank, word AS text, kind, round(greatest(0.01, least(0.99, ln(token_count + 1.0) / ln({search.SCORE_FREQUENCY} + 1.0) * 0.35 + {bonus} + CASE WHEN (starts_with(word, q) OR {alike}) AND strlen(q) >= 2 THEN 0.25 ELSE 0 END - edit_cost / 10 * 0.35))::DOUBLE, 9) AS score,
        edit_cost, zipf_milli, document_count, CASE WHEN kind = 'Completion' THEN 'prefix match quality ' || prefix_quality ELSE 'lower edit cost (cost: ' || edit_cost || ')' END
          || CASE WHEN zipf_milli > 0 THEN ', then higher frequency (zipf_milli: ' || zipf_milli || ')' ELSE ', then lexical order' END AS ranking_reason FROM ranked WHERE rank <= 10"""


PREV = "SELECT DISTINCT word AS previous FROM (SELECT unnest({w}) AS word FROM benchmark)".format(w=P.SQL_WORDS)


def predicted(spark, sf_dir):
    contexts = benchmark_words(spark, sf_dir).select(F.col("query").alias("previous"))
    return predict.by_bigram(contexts, ngrams.model(P.docs(spark, sf_dir), 2, contexts=contexts))


def predicted_backoff(spark, sf_dir):
    contexts = ngrams.windows(P.read(spark, sf_dir, "benchmark"), 2).select(F.col("previous").alias("previous_2"), F.col("next").alias("previous_1"))
    return predict.backoff_of(contexts, P.docs(spark, sf_dir))


def asked_next(spark, sf_dir):
    """Contexts of no, one, two and more words."""
    asks = spark.createDataFrame([([],), (["the"],), (["the", "and"],), (["zzz", "of", "the"],), (["zzz"],)], "context array<string>")
    d = P.docs(spark, sf_dir)
    last = asks.filter("size(context) > 0").select(F.element_at("context", -1).alias("previous"))
    pairs = asks.filter("size(context) > 1").select(F.element_at("context", -2).alias("previous_2"), F.element_at("context", -1).alias("previous_1"))
    return predict.predict_next(asks, ngrams.model(d, 2, contexts=last), ngrams.model(d, 3, contexts=pairs))


_BI, _TRI = P.ORACLE["bigram_topk"], P.ORACLE["trigram_topk"]
#: Predictions for `pairs` (previous_2, previous_1).
BACKOFF = f"""SELECT previous_2, previous_1, rank, next, count, probability_millionths, 'trigram' AS prediction_source FROM pairs JOIN ({_TRI}) USING (previous_2, previous_1) WHERE rank <= 5 UNION ALL
  SELECT previous_2, previous_1, rank, next, count, probability_millionths, 'bigram-backoff' FROM pairs JOIN ({_BI}) ON previous = previous_1
  WHERE rank <= 5 AND (previous_2, previous_1) NOT IN (SELECT (previous_2, previous_1) FROM ({_TRI}))"""
_BENCH_PAIRS = P.ORACLE["bigrams"].replace("FROM documents", "FROM (SELECT item_id AS doc_id, text, '' AS source, '' AS lang FROM benchmark)")


def records(spark, sf_dir):
    """The lexicon's words as an imported list, in order; of every seventh the first letter, if it is a to z, is a capital."""
    from textlex.operators.ordering import with_position

    at = with_position(P.lexicon(spark, sf_dir).select("word"), ["word"])
    return at.select((F.col("position") + 1).alias("line_num"), F.when((F.col("position") % 7 == 0) & F.col("word").rlike("^[a-z]"), F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))).otherwise(F.col("word")).alias("word"), F.col("word").alias("normalized"))


REC = f"""{P.LEXICON}, numbered AS (SELECT word, row_number() OVER (ORDER BY word) AS n FROM lexicon), records AS (SELECT n AS line_num,
  CASE WHEN (n - 1) % 7 = 0 AND regexp_matches(word, '^[a-z]') THEN upper(word[1]) || word[2:] ELSE word END AS word, word AS normalized FROM numbered)"""
G = "length_grapheme(normalized)"
NOWS = f"regexp_replace(normalized, '[{WS}]+', '', 'g')"
LET = "regexp_replace(word, '[^\\p{L}]+', '', 'g')"
SHAPES = {
    "punctuation_only": f"regexp_matches({NOWS}, '^\\p{{P}}+$')",
    "symbol_only": f"regexp_matches({NOWS}, '^\\p{{S}}+$')",
    "digit_only": f"regexp_matches({NOWS}, '^\\p{{N}}+$')",
    "no_letters": f"NOT regexp_matches({NOWS}, '\\p{{L}}')",
    "uppercase_only": "regexp_matches(word, '\\p{Lu}') AND NOT regexp_matches(word, '\\p{Ll}')",
    "title_case": f"regexp_matches({LET}, '^\\p{{Lu}}\\p{{Ll}}+$')",
    "mixed_case": f"regexp_matches(word, '\\p{{Lu}}') AND regexp_matches(word, '\\p{{Ll}}') AND NOT regexp_matches({LET}, '^\\p{{Lu}}\\p{{Ll}}+$')",
    "contains_digits": f"regexp_matches({NOWS}, '\\p{{N}}') AND regexp_matches({NOWS}, '\\p{{L}}')",
    "contains_hyphen": "contains(normalized, '-')",
    "contains_apostrophe": "regexp_matches(normalized, '[''’]')",
    "multiword": "contains(normalized, ' ')",
    "very_short": f"{G} <= 1",
    "very_long_25": f"{G} > 25",
    "very_long_40": f"{G} > 40",
    "possible_proper_noun": f"regexp_matches({LET}, '^\\p{{Lu}}\\p{{Ll}}+$')",
    "total": "true",
}
SCRIPT = """(SELECT CASE WHEN NOT l AND NOT a AND NOT c AND NOT o THEN 'NO_SCRIPTED_LETTERS' WHEN l AND NOT a AND NOT c AND NOT o THEN 'LATIN_ONLY' WHEN a AND NOT l AND NOT c AND NOT o THEN 'ARABIC_ONLY'
  WHEN c AND NOT l AND NOT a AND NOT o THEN 'CYRILLIC_ONLY' WHEN l AND a AND NOT c AND NOT o THEN 'LATIN_ARABIC_MIXED' WHEN l AND c AND NOT a AND NOT o THEN 'LATIN_CYRILLIC_MIXED'
  WHEN o AND NOT l AND NOT a AND NOT c THEN CASE WHEN regexp_matches(t, '^\\p{Greek}+$') THEN 'OTHER_SINGLE_SCRIPT:Greek' WHEN regexp_matches(t, '^\\p{Han}+$') THEN 'OTHER_SINGLE_SCRIPT:Han' ELSE 'OTHER_MIXED_SCRIPT' END
  ELSE 'OTHER_MIXED_SCRIPT' END FROM (SELECT t, regexp_matches(t, '\\p{Latin}') AS l, regexp_matches(t, '\\p{Arabic}') AS a, regexp_matches(t, '\\p{Cyrillic}') AS c, regexp_matches(t, '[^\\p{Latin}\\p{Arabic}\\p{Cyrillic}]') AS o
  FROM (SELECT regexp_replace(normalized, '[^\\p{L}]', '', 'g') AS t)))"""
CHARS = """chars AS (SELECT coalesce(a.char, b.char) AS char, coalesce(a.n, 0)::BIGINT AS word_occurrences, coalesce(a.e, 0) AS word_entries, coalesce(b.n, 0)::BIGINT AS normalized_occurrences, coalesce(b.e, 0) AS normalized_entries FROM
  (SELECT char, count(*) AS n, count(DISTINCT line_num) AS e FROM (SELECT line_num, unnest(string_split(word, '')) AS char FROM records) GROUP BY 1) a FULL JOIN
  (SELECT char, count(*) AS n, count(DISTINCT line_num) AS e FROM (SELECT line_num, unnest(string_split(normalized, '')) AS char FROM records) GROUP BY 1) b ON a.char = b.char)"""


def _audit_sql(base: str) -> dict[str, str]:
    s = SHAPES
    rules = [
        (s["punctuation_only"], "'PUNCTUATION_ONLY'", "PUNCTUATION_ONLY_ACCEPTED"),
        (s["symbol_only"], "'SYMBOL_ONLY'", "SYMBOL_ONLY_ACCEPTED"),
        (s["digit_only"], "'DIGIT_ONLY'", "DIGIT_ONLY_ACCEPTED"),
        (f"{s['no_letters']} AND NOT ({s['punctuation_only']}) AND NOT ({s['symbol_only']}) AND NOT ({s['digit_only']})", "'NO_LETTERS'", "NO_LETTERS_ACCEPTED"),
        (f"contains({SCRIPT}, 'MIXED')", SCRIPT, "MIXED_SCRIPT_ACCEPTED"),
        (s["very_long_25"], "'VERY_LONG'", "VERY_LONG_ENTRY"),
        ("EXISTS (SELECT 1 FROM rare WHERE contains(normalized, rare.char))", "'RARE_CODEPOINT'", "RARE_LETTER_CODEPOINT"),
    ]
    sus = " UNION ALL ".join(f"SELECT {c} AS category, '{code}' AS reason_code, normalized, word, line_num FROM records WHERE {w}" for w, c, code in rules)
    pct = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, percent, list_sort(l)[least(percent * len(l) // 100, len(l) - 1) + 1] AS length FROM (SELECT list({f}) AS l FROM records), (SELECT unnest({audit.PERCENTILES}) AS percent)"
        for m, f in (("scalar", "length(normalized)"), ("grapheme", G))
    )
    pick = lambda name, where, order: f"(SELECT normalized, line_num, '{name}' AS category FROM records WHERE {where} ORDER BY {order}normalized, line_num LIMIT 10)"
    return {
        "char_inventory": f"WITH {base}, {CHARS} SELECT *, printf('U+%04X', unicode(char)) AS code_point FROM chars",
        "shape_counts": f"WITH {base} " + " UNION ALL ".join(f"SELECT '{k}' AS shape, count(*) FILTER ({c}) AS entries FROM records" for k, c in s.items()),
        "script_counts": f"WITH {base} SELECT {SCRIPT} AS script, count(*) AS entries FROM records GROUP BY 1",
        "length_percentiles": f"WITH {base} {pct}",
        "suspicious": f"WITH {base}, {CHARS}, rare AS (SELECT char FROM chars WHERE normalized_entries BETWEEN 1 AND 4 AND regexp_matches(char, '\\p{{L}}')) {sus}",
        "stride_sample": f"""WITH {base}, p AS (SELECT normalized, line_num, row_number() OVER (ORDER BY normalized, line_num) - 1 AS pos, greatest(1, count(*) OVER () // 10) AS size FROM records),
          b AS (SELECT *, pos // size AS bucket, pos % size AS inside, greatest(1, size // 5) AS stride FROM p)
          SELECT normalized, line_num, bucket FROM b WHERE bucket < 10 AND inside % stride = 0 AND inside // stride < 5""",
        "category_samples": f"""WITH {base}, {CHARS}, rare AS (SELECT char FROM chars WHERE normalized_entries BETWEEN 1 AND 4 AND regexp_matches(char, '\\p{{L}}')) SELECT normalized, line_num, string_agg(category, ',' ORDER BY category) AS categories FROM ({pick('shortest', 'true', G + ', ')} UNION ALL
          {pick('longest', 'true', G + ' DESC, ')} UNION ALL {pick('rare_character', "EXISTS (SELECT 1 FROM rare WHERE contains(normalized, rare.char))", '')} UNION ALL {pick('proper_noun', s['title_case'], '')} UNION ALL {pick('mixed_script', f"contains({SCRIPT}, 'MIXED')", '')}) GROUP BY 1, 2""",
    }


#: General categories.
CATEGORIES = "Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Co Cs".split()
_AUDITS = {f.__name__: f for f in (audit.char_inventory, audit.shape_counts, audit.script_counts, audit.length_percentiles, audit.suspicious, audit.stride_sample, audit.category_samples)}
PARSED = rf"""{LINES.sql}, cut AS (SELECT *, regexp_replace(line, '{P.SQL_TRIM}', '', 'g') AS t FROM lines),
 split AS (SELECT *, regexp_split_to_array(t, '[{WS}]+') AS p, regexp_extract(regexp_split_to_array(t, '[{WS}]+')[1], '^((?:\\/|[^/])*)', 1) AS body FROM cut),
 base AS (SELECT line_num, line, t, replace(body, '\/', '/') AS word, p[1][length(body) + 2:] AS flags, p[2:] AS morphology FROM split),
 norm AS (SELECT *, lower(nfc_normalize(regexp_replace(word, '[\p{{Cc}}\x{{200B}}\x{{FEFF}}]', '', 'g'))) AS normalized, line_num = 1 AND regexp_matches(t, '^[0-9]+$') AS isdec,
   coalesce(lower(list_filter(morphology, lambda m: starts_with(m, 'po:'))[1][4:]), 'unknown') AS tag FROM base),
 parsed AS (SELECT line_num, line, CASE WHEN isdec THEN 'DeclaredCount' WHEN t = '' THEN 'Blank' WHEN rs IS NOT NULL THEN 'Rejected' ELSE 'Parsed' END AS event, CASE WHEN isdec THEN t::BIGINT END AS declared,
   word, normalized, flags, array_to_string(morphology, ' ') AS morphology, CASE WHEN tag IN ('n', 'noun') THEN 'noun' WHEN tag IN ('v', 'verb') THEN 'verb' WHEN tag = 'ij' THEN 'interjection' ELSE tag END AS part_of_speech,
   CASE WHEN NOT isdec AND t <> '' THEN rs END AS reason FROM (SELECT *, CASE WHEN word = '' THEN 'EMPTY_WORD' WHEN regexp_matches(word, '[<>]|^https?://') THEN 'FORBIDDEN_CHARACTERS' WHEN length(normalized) NOT BETWEEN 1 AND 64 THEN 'INVALID_LENGTH' END AS rs FROM norm)),
 outcomes AS (SELECT line_num, normalized, first_value(line_num) OVER w AS first_line, CASE WHEN line_num = first_value(line_num) OVER w THEN 'accepted'
   WHEN (word, flags, morphology, part_of_speech) = (first_value(word) OVER w, first_value(flags) OVER w, first_value(morphology) OVER w, first_value(part_of_speech) OVER w) THEN 'exact_duplicate' ELSE 'metadata_conflict' END AS outcome
   FROM parsed WHERE event = 'Parsed' WINDOW w AS (PARTITION BY normalized ORDER BY line_num))"""


def parsed(spark):
    return lexicon.parse_lines(LINES.frame(spark))


QUERIES = {
    "known_word": lambda s, d: search.known_words(benchmark_words(s, d), search_lexicon(s, d)),
    "prefix_complete": prefixes,
    "diacritic_restore": restored,
    "edit_candidates": edits,
    "suggest_topk": suggestions,
    "suggest_seed": seed_suggestions,
    "predict_bigram": predicted,
    "predict_backoff": predicted_backoff,
    "lexicon_validate": lambda s, d: ENTRIES.frame(s).select("ord", lexicon.entry_problem().alias("problem")),
    "lexicon_merge": lambda s, d: lexicon.merge(ENTRIES.frame(s)).withColumns({c: F.concat_ws("|", c) for c in ("sources", "variants")}),
    "freq_join": lambda s, d: lexicon.with_frequency(benchmark_words(s, d).select(F.col("query").alias("normalized")), P.lexicon(s, d)),
    "freq_coverage": lambda s, d: lexicon.frequency_coverage(lexicon.with_frequency(benchmark_words(s, d).select(F.col("query").alias("normalized")), P.lexicon(s, d))),
    "dic_parse": lambda s, d: parsed(s).withColumn("morphology", F.concat_ws(" ", "morphology")),
    "dic_import": lambda s, d: lexicon.import_outcomes(parsed(s)).select("line_num", "normalized", "first_line", "outcome"),
    "dic_summary": lambda s, d: lexicon.import_summary(parsed(s)),
    "flag_frequency": lambda s, d: audit.flag_frequency(parsed(s).filter("event = 'Parsed'")),
    "morphology_frequency": lambda s, d: audit.morphology_frequency(parsed(s).filter("event = 'Parsed'")),
    "pos_frequency": lambda s, d: audit.pos_frequency(parsed(s).filter("event = 'Parsed'")),
    "raw_line_findings": lambda s, d: audit.raw_line_findings(P.docs(s, d).select(F.explode(F.split("text", "\n")).alias("line"))),
    "seed_overlap": lambda s, d: audit.overlap(benchmark_words(s, d).select(F.col("query").alias("normalized")), P.lexicon(s, d).select(F.col("word").alias("normalized"))),
    **{name: lambda s, d, f=f: f(records(s, d)) for name, f in _AUDITS.items()},
    **{f"{name}_inline": lambda s, d, f=f: f(RECORDS.frame(s)) for name, f in _AUDITS.items()},
    "length_histogram": lambda s, d: audit.length_histogram(records(s, d)),
    "length_summary": lambda s, d: audit.length_summary(records(s, d)),
    "exact_duplicates": lambda s, d: audit.exact_duplicates(parsed(s).filter("event = 'Parsed'")),
    "rejections": lambda s, d: audit.rejections(parsed(s)),
    "cross_check": lambda s, d: audit.cross_check(parsed(s)),
    "predict_next": asked_next,
    "lexicon_order": lambda s, d: lexicon.ordered(lexicon.combined(ENTRIES.frame(s).filter("ord <= 4"), ENTRIES.frame(s).filter("ord > 4"))).select("frequency", "normalized", "word"),
    "general_category": lambda s, d: audit.char_inventory(records(s, d)).select("char", T.general_category(F.col("char")).alias("category")),
}
ORACLE = {
    "known_word": f"WITH {LEX} SELECT query, query IN (SELECT word FROM lexicon) AS known FROM ask",
    "prefix_complete": f"WITH {LEX}, q AS (SELECT DISTINCT query[1:4] AS query FROM ask) SELECT query, word FROM q JOIN lexicon ON starts_with(word, query)",
    "diacritic_restore": f"WITH {P.LEXICON}, q AS (SELECT DISTINCT {PLAIN('word')} AS query FROM lexicon) SELECT query, word FROM q JOIN lexicon ON {PLAIN('word')} = query AND word <> query",
    "edit_candidates": f"WITH RECURSIVE {LEX}, lex AS (SELECT word, word AS normalized FROM lexicon), {edits_sql('ask', 'lex')} SELECT query, word, quarters, (quarters * 5 + 1) // 2 AS edit_cost FROM edited",
    "suggest_topk": f"WITH RECURSIVE {LEX}, lex AS (SELECT word, word AS normalized, token_count, document_count, round(zipf * 1000)::BIGINT AS zipf_milli FROM lexicon), {suggest_sql('ask', 'lex')}",
    "suggest_seed": f"WITH RECURSIVE {ASKED.sql}, {SEED.sql}, {suggest_sql('asked', 'seed')}",
    "general_category": f"WITH {REC}, {CHARS} SELECT char, CASE {' '.join(f"WHEN regexp_matches(char, '^\\p{{{c}}}$') THEN '{c}'" for c in CATEGORIES)} ELSE 'Cn' END AS category FROM chars",
    "length_histogram": f"WITH {REC} SELECT 'scalar' AS measure, length(normalized) AS length, count(*) AS entries FROM records GROUP BY 2 UNION ALL SELECT 'grapheme', {G}, count(*) FROM records GROUP BY 2",
    "length_summary": f"WITH {REC}, l AS (SELECT 'scalar' AS measure, length(normalized) AS n FROM records UNION ALL SELECT 'grapheme', {G} FROM records) SELECT measure, min(n) AS least, max(n) AS largest, sum(n)::BIGINT AS mean_numerator, count(*) AS mean_denominator, round(sum(n) / count(*), 4) AS mean FROM l GROUP BY 1",
    "exact_duplicates": f"""WITH {PARSED}, p AS (SELECT * FROM parsed WHERE event = 'Parsed') SELECT normalized, arg_min(word, line_num) AS word, arg_min(flags, line_num) AS flags, arg_min(part_of_speech, line_num) AS part_of_speech, count(*) AS occurrences,
      list_sort(list(line_num)) AS lines FROM p GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT (word, flags, morphology, part_of_speech)) = 1""",
    "rejections": f"WITH {PARSED} SELECT reason, count(*) AS lines FROM parsed WHERE event = 'Rejected' GROUP BY 1",
    "cross_check": f"""WITH {PARSED}, f AS (SELECT normalized, count(*) FILTER (outcome = 'exact_duplicate') AS e, count(*) FILTER (outcome = 'metadata_conflict') AS c, count(*) AS n FROM outcomes GROUP BY 1)
      SELECT sum(e)::BIGINT AS exact_duplicates, sum(c)::BIGINT AS conflicting, count(*) FILTER (c > 0) AS conflict_groups, coalesce(sum(n - e) FILTER (c > 0), 0)::BIGINT AS conflict_members, count(*) AS unique_forms FROM f""",
    "predict_next": f"""WITH asks AS (SELECT unnest([[], ['the'], ['the', 'and'], ['zzz', 'of', 'the'], ['zzz']]) AS context), pairs AS (SELECT DISTINCT context[-2] AS previous_2, context[-1] AS previous_1 FROM asks WHERE len(context) > 1)
      SELECT context, rank, next, count, probability_millionths, 'bigram' AS prediction_source FROM asks JOIN ({_BI}) ON previous = context[1] WHERE len(context) = 1 AND rank <= 5 UNION ALL
      SELECT context, rank, next, count, probability_millionths, prediction_source FROM asks JOIN ({BACKOFF}) b ON b.previous_2 = context[-2] AND b.previous_1 = context[-1] WHERE len(context) > 1""",
    "predict_bigram": f"SELECT previous, rank, next, count, probability_millionths FROM ({_BI}) JOIN ({PREV}) USING (previous) WHERE rank <= 5",
    "predict_backoff": f"WITH pairs AS ({_BENCH_PAIRS.replace('WHERE count >= 2', '').replace('SELECT * FROM model', 'SELECT DISTINCT previous AS previous_2, next AS previous_1 FROM counts')}) {BACKOFF}",
    "lexicon_validate": f"""WITH {ENTRIES.sql} SELECT ord, CASE WHEN trim(word) = '' THEN 'EMPTY_WORD' WHEN trim(normalized) = '' THEN 'EMPTY_NORMALIZED' WHEN trim(status) = '' THEN 'EMPTY_STATUS'
      WHEN length(normalized) NOT BETWEEN 1 AND 64 THEN 'INVALID_LENGTH' WHEN regexp_matches(word, '[<>]|^https?://') THEN 'FORBIDDEN_CHARACTERS'
      WHEN regexp_matches(normalized, '[^\\p{{L}}''’\\- ]') THEN 'INVALID_CHARACTER' END AS problem FROM entries""",
    "lexicon_order": f"""WITH {ENTRIES.sql}, m AS ({{merge}}) SELECT frequency, normalized, word FROM m""",
    "lexicon_merge": f"""WITH {ENTRIES.sql}, f AS (SELECT normalized, arg_min(word, ord) AS w, arg_min(lemma, ord) AS lemma, arg_min(part_of_speech, ord) AS part_of_speech, arg_min(status, ord) AS status, max(frequency) AS frequency,
      arg_min(word, ord) FILTER (regexp_matches(word, '^\\p{{Ll}}') AND part_of_speech <> 'proper_noun') AS plain,
      array_to_string(list_sort(list_distinct(flatten(list(sources)))), '|') AS sources, array_to_string(list_sort(list_distinct(flatten(list(variants)))), '|') AS variants FROM entries GROUP BY 1)
      SELECT CASE WHEN regexp_matches(w, '^\\p{{Lu}}') AND plain IS NOT NULL THEN plain ELSE w END AS word, lemma, normalized, part_of_speech, frequency, status, sources, variants FROM f""",
    "freq_join": f"""WITH {LEX} SELECT query AS normalized, coalesce(token_count, 0) AS token_count, coalesce(document_count, 0) AS document_count, coalesce(round(zipf * 1000)::BIGINT, 0) AS zipf_milli
      FROM ask LEFT JOIN lexicon ON word = query""",
    "freq_coverage": f"WITH {LEX} SELECT count(*) AS entries, count(word) AS matched, count(*) - count(word) AS unmatched FROM ask LEFT JOIN lexicon ON word = query",
    "dic_parse": f"WITH {PARSED} SELECT * FROM parsed",
    "dic_import": f"WITH {PARSED} SELECT * FROM outcomes",
    "dic_summary": f"""WITH {PARSED} SELECT (SELECT max(declared) FROM parsed) AS declared, (SELECT count(*) FROM parsed WHERE event = 'Blank') AS blank, (SELECT count(*) FROM parsed WHERE event = 'Rejected') AS rejected,
      count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'exact_duplicate') AS exact_duplicate, count(*) FILTER (outcome = 'metadata_conflict') AS metadata_conflict FROM outcomes""",
    "flag_frequency": f"WITH {PARSED} SELECT flags, count(*) AS entries FROM parsed WHERE event = 'Parsed' GROUP BY 1",
    "morphology_frequency": f"WITH {PARSED} SELECT tag, count(*) AS entries FROM (SELECT unnest(string_split(morphology, ' ')) AS tag FROM parsed WHERE event = 'Parsed' AND morphology <> '') GROUP BY 1",
    "pos_frequency": f"WITH {PARSED} SELECT part_of_speech, count(*) AS entries FROM parsed WHERE event = 'Parsed' GROUP BY 1",
    "raw_line_findings": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT regexp_matches(line, '^[{WS}]') AS leading_space, regexp_matches(line, '[{WS}]\\z') AS trailing_space, contains(line, chr(9)) AS tab,
      regexp_matches(line, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]') AS control, contains(line, chr(13)) AS carriage_return, contains(line, chr(0)) AS null_byte, contains(line, chr(65533)) AS replacement FROM l)
      SELECT count(*) FILTER (leading_space) AS leading_space, count(*) FILTER (trailing_space) AS trailing_space, count(*) FILTER (tab) AS tab, count(*) FILTER (control) AS control, count(*) FILTER (carriage_return) AS carriage_return,
      count(*) FILTER (null_byte) AS null_byte, count(*) FILTER (replacement) AS replacement, count(*) FILTER (leading_space OR trailing_space OR tab OR control OR carriage_return OR null_byte OR replacement) AS lines FROM f""",
    "seed_overlap": f"""WITH {LEX} SELECT (SELECT count(*) FROM ask) AS seed, (SELECT count(*) FROM lexicon) AS imported, (SELECT count(*) FROM ask WHERE query IN (SELECT word FROM lexicon)) AS both,
      (SELECT count(*) FROM ask WHERE query NOT IN (SELECT word FROM lexicon)) AS seed_only, (SELECT count(*) FROM lexicon WHERE word NOT IN (SELECT query FROM ask)) AS imported_only""",
    **_audit_sql(REC),
    **{f"{k}_inline": v for k, v in _audit_sql(RECORDS.sql).items()},
}
ORACLE["lexicon_order"] = ORACLE["lexicon_order"].format(merge=ORACLE["lexicon_merge"].split("WITH ", 1)[1].join(("WITH ", "")))
