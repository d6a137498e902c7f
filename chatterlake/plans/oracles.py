"""The same results in SQL that DuckDB runs on the same tables.

Written step by step, with none of the short cuts of the Spark side: texts are cleaned in six
sequential replacements, windows are listed one by one, ranks come from window functions.
"""

from __future__ import annotations

from chatterlake.functions import fixed_values as fv
from chatterlake.plans import fixtures, queries

ORACLES: dict[str, str] = {}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words_in(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


WHITE = "concat(" + ", ".join(f"chr({ord(c)})" for c in fv.WHITESPACE) + ")"
WS = f"[{fv.WS_CLASS}]"
NWS = fv.NON_WS


def strip(c: str) -> str:
    return f"trim({c}, {WHITE})"


POSTS = f"""posts AS (
  SELECT {fixtures.POST_ID} AS post_id, {fixtures.CONTENT} AS content, lang, source, {fixtures.POSTED_AT} AS posted_at,
    {fixtures.SENTIMENT} AS sentiment, {fixtures.SCORE} AS score, {fixtures.REPLY} AS reply
  FROM documents d CROSS JOIN (VALUES (0), (1)) c(added)
  LEFT JOIN (SELECT doc_id AS label_id, quality, toxic FROM labels) l ON d.doc_id = l.label_id
  WHERE added = 0 OR {fixtures.ADDED})"""

COMMENTS = f"""comments AS (
  SELECT {fixtures.COMMENT_ID} AS comment_id, {fixtures.COMMENT} AS comment,
    CASE conv_id % 4 WHEN 0 THEN '已有译文' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE '' END AS translation
  FROM conversations CROSS JOIN (VALUES (0), (1)) c(added) WHERE added = 0 OR {fixtures.COMMENT_ADDED})"""

TIME = """try_strptime(posted_at, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y/%m/%d %H:%M', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d'])"""
DATED = f"dated AS (SELECT CAST({TIME} AS DATE) AS day, * FROM posts WHERE {TIME} IS NOT NULL)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def posts_sql(select: str, *parts: str) -> str:
    return with_(POSTS, *parts) + select


# --- scans and cleaning -----------------------------------------------------------------------
ORACLES["scan_posts"] = posts_sql("SELECT * FROM posts")
_nulls = words_in(fv.NULL_LITERALS)
_read_back = ", ".join(f"CASE WHEN {c} NOT IN {_nulls} THEN {c} END AS {c}" for c in ("content", "lang", "source"))
ORACLES["csv_by_splits"] = posts_sql(f"SELECT post_id, {_read_back} FROM posts")
ORACLES["preview"] = posts_sql("SELECT * FROM posts ORDER BY post_id LIMIT 5")
_cells = ", ".join(quoted(v) for v in (*fv.NULL_LITERALS, " NA", "na", "Null"))
ORACLES["null_literals"] = f"""
SELECT doc_id, CASE WHEN cell NOT IN {words_in(fv.NULL_LITERALS)} THEN cell END AS cell
FROM (SELECT doc_id, coalesce([{_cells}][doc_id % 29 + 1], source) AS cell FROM documents)"""
NOT_BLANK = f"content IS NOT NULL AND {strip('content')} <> ''"
_clean = f"SELECT DISTINCT content, lang, source, posted_at, sentiment, score FROM posts WHERE {NOT_BLANK}"
ORACLES["clean_posts"] = posts_sql(_clean)
_ranked = """first AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY post_id) AS rn
  FROM posts WHERE content IS NOT NULL)"""
ORACLES["dedupe_by_text"] = posts_sql("SELECT post_id, content, lang, source FROM first WHERE rn = 1", _ranked)
_placed = "placed AS (SELECT *, row_number() OVER (ORDER BY post_id) - 1 AS position FROM posts)"
_first_placed = """first AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY position) AS rn
  FROM placed WHERE content IS NOT NULL)"""
ORACLES["first_without_key"] = posts_sql(
    "SELECT content, lang, source, position FROM first WHERE rn = 1", _placed, _first_placed
)
ORACLES["parse_time"] = posts_sql(
    f"SELECT post_id, strftime({TIME}, '%Y-%m-%d %H:%M:%S') AS at, CAST({TIME} AS DATE) AS day FROM posts"
)
ORACLES["dataset_summary"] = (
    with_(POSTS, COMMENTS)
    + f"""SELECT dataset, count(*)::BIGINT AS n_rows, count_if({NOT_BLANK})::BIGINT AS with_text,
  count(DISTINCT content)::BIGINT AS texts
FROM (SELECT 'posts' AS dataset, content FROM posts UNION ALL SELECT 'comments', comment FROM comments)
GROUP BY dataset"""
)

# --- trends and labels ------------------------------------------------------------------------
_LABEL_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE sentiment = '{name}')::BIGINT AS {name}"
    for name in ("negative", "neutral", "positive", "unknown")
)
ORACLES["posts_per_day"] = posts_sql("SELECT day, count(*)::BIGINT AS n FROM dated GROUP BY day", DATED)
ORACLES["sentiment_per_day"] = posts_sql(
    f"SELECT day, {_LABEL_COUNTS} FROM dated WHERE sentiment IS NOT NULL GROUP BY day", DATED
)
ORACLES["avg_sentiment_per_day"] = posts_sql(
    "SELECT day, round(avg(score), 6) AS avg_score FROM dated GROUP BY day", DATED
)
ORACLES["daily_trends"] = posts_sql(
    f"SELECT day, count(*)::BIGINT AS n, {_LABEL_COUNTS}, round(avg(score), 6) AS avg_score FROM dated GROUP BY day",
    DATED,
)
ORACLES["cleaned_sentiment_per_day"] = posts_sql(
    f"SELECT CAST({TIME} AS DATE) AS day, {_LABEL_COUNTS} FROM cleaned "
    f"WHERE {TIME} IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1",
    f"cleaned AS ({_clean})",
)
_event_counts = ", ".join(
    f"count(*) FILTER (WHERE event_type = '{name}')::BIGINT AS {name}"
    for name in ("click", "error", "purchase", "signup", "view")
)
ORACLES["events_per_day"] = f"""
SELECT CAST(ts AS DATE) AS day, count(*)::BIGINT AS n, {_event_counts}, round(avg(value), 4) AS avg_score
FROM events WHERE ts IS NOT NULL GROUP BY 1"""
for _label in fv.LABELS:
    ORACLES[f"split_{_label}"] = posts_sql(
        f"SELECT post_id, content, sentiment, score FROM posts WHERE sentiment = '{_label}'"
    )
ORACLES["run_summary"] = posts_sql(
    "SELECT count(*)::BIGINT AS total, count_if(sentiment IS NULL OR score IS NULL)::BIGINT AS to_do FROM posts"
)
ORACLES["pending_rows"] = posts_sql(
    "SELECT post_id, sentiment, score FROM posts WHERE sentiment IS NULL OR score IS NULL"
)


# --- text -------------------------------------------------------------------------------------
def replaced(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {quoted(pattern)}, {quoted(by)}, 'g')"


STEPS = {
    "urls": (f"https?://{NWS}+", " "),
    "mentions": (f"@{NWS}+", " "),
    "hash_topics": ("#([^#]+)#", r" \1 "),
    "keycaps": (r"[0-9#*]\x{FE0F}?\x{20E3}", " "),
    "other": ("[^0-9A-Za-z一-鿿]+", " "),
}


def clean_text(c: str) -> str:
    out = strip(c)
    for pattern, by in STEPS.values():
        out = replaced(out, pattern, by)
    return f"coalesce(trim({out}), '')"


def tokens(c: str) -> str:
    runs = f"regexp_extract_all({c}, '([0-9A-Za-z]+|[一-鿿]+)', 1)"
    return f"""flatten(list_transform({runs}, lambda w: CASE WHEN w >= '一' AND length(w) >= 2
      THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END))"""


def topic_tokens(c: str) -> str:
    text = replaced(f"lower({strip(c)})", rf"http{NWS}+|www[^\n]{NWS}+", "")
    return f"""list_filter({tokens(text)},
      lambda t: length(t) > 1 AND t NOT IN {words_in(fv.TOPIC_STOP_WORDS)})"""


def word_rules(t: str) -> str:
    return f"""CASE WHEN length({t}) = 1 OR regexp_full_match({t}, '[0-9]+') THEN NULL
      WHEN regexp_full_match({t}, '[A-Za-z]+') THEN CASE WHEN length({t}) > 2 THEN lower({t}) END ELSE {t} END"""


ORACLES["strip_text"] = posts_sql(f"SELECT post_id, {strip('content')} AS stripped FROM posts")
ORACLES["strip_urls"] = posts_sql(
    "SELECT post_id, " + replaced("content", rf"http{NWS}+|www[^\n]{NWS}+", "") + " AS without_urls FROM posts"
)
ORACLES["clean_text"] = posts_sql(f"SELECT post_id, {clean_text('content')} AS cleaned FROM posts")
ORACLES["text_steps"] = posts_sql(
    "SELECT post_id, "
    + ", ".join(f"{replaced('content', *STEPS[s])} AS {s}" for s in list(STEPS)[:4])
    + " FROM posts"
)
_share = "length(regexp_replace(content, '[^一-鿿]', '', 'g')) / length(content)::DOUBLE"
ORACLES["chinese_flag"] = posts_sql(
    f"""SELECT post_id, coalesce(CASE WHEN length(content) > 0 THEN {_share} > 0.2 END, false) AS chinese,
  CASE WHEN length(content) > 0 THEN round({_share}, 6) END AS share FROM posts"""
)
ORACLES["segment"] = posts_sql(
    f"SELECT post_id, coalesce(array_to_string({tokens('cleaned')}, '|'), '') AS tokens "
    f"FROM (SELECT post_id, {clean_text('content')} AS cleaned FROM posts)"
)
ORACLES["token_rules"] = posts_sql(
    f"""SELECT post_id, coalesce(array_to_string(list_filter(list_transform(tokens, lambda t: {word_rules('t')}),
    lambda w: w IS NOT NULL), '|'), '') AS words
FROM (SELECT post_id, {tokens('cleaned')} AS tokens
  FROM (SELECT post_id, {clean_text('content')} AS cleaned FROM posts))"""
)
ORACLES["lda_tokens"] = posts_sql(
    f"""SELECT post_id, CASE WHEN content IS NOT NULL
  THEN coalesce(array_to_string({topic_tokens('content')}, '|'), '') END AS tokens FROM posts"""
)
_dictionary = "|".join(sorted(queries.USER_WORDS, key=lambda w: (-len(w), w)))
ORACLES["segment_with_dictionary"] = posts_sql(
    f"""SELECT post_id, CASE WHEN content IS NOT NULL THEN coalesce(array_to_string(flatten(list_transform(
    regexp_extract_all(marked, '(<[一-鿿]+>|[0-9A-Za-z]+|[一-鿿]+)', 1), lambda w:
      CASE WHEN w[1] = '<' THEN [substr(w, 2, length(w) - 2)] WHEN w >= '一' AND length(w) >= 2
      THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END)), '|'), '') END AS tokens
FROM (SELECT post_id, content, {replaced("translate(content, '<>', '  ')", f"({_dictionary})", "<\\1>")} AS marked FROM posts)"""
)

# --- replies and requests ---------------------------------------------------------------------
_no_think = strip("regexp_replace(coalesce(reply, ''), '(?s)<think>.*?</think>', '', 'g')")
_word = "[^0-9A-Za-z_一-鿿]"
_found = (
    f"(?i)(?:^|{_word})(positive|negative|neutral){WS}*,{WS}*(0?\\.[0-9]{{2}}|1\\.00)(?:$|{_word})"
)
_number = (
    r"[+-]?(([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?"
    r"|(?i:nan|inf|infinity))"
)


def parts(raw: str) -> str:
    number = f"CASE WHEN strpos(raw, ',') > 0 THEN {strip('substr(raw, strpos(raw, chr(44)) + 1)')} END"
    return f"""(SELECT *, lower({strip("CASE WHEN strpos(raw, ',') > 0 THEN substr(raw, 1, strpos(raw, ',') - 1) ELSE raw END")}) AS label,
  CASE WHEN regexp_full_match({number}, {quoted(_number)})
    THEN TRY_CAST(replace({number}, '_', '') AS DOUBLE) END AS v FROM ({raw}))"""


def parsed_local(source: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN hit <> '' THEN lower(hit) WHEN ok THEN label ELSE 'unknown' END AS sentiment,
  CASE WHEN hit <> '' THEN CAST(hit_score AS DOUBLE) WHEN ok THEN CAST(format('{{:.2f}}', v) AS DOUBLE) ELSE 0.0 END AS score
FROM (SELECT *, regexp_extract(raw, {quoted(_found)}, 1) AS hit, regexp_extract(raw, {quoted(_found)}, 2) AS hit_score,
    label IN ('positive', 'negative', 'neutral') AND coalesce(NOT isnan(v) AND v BETWEEN 0 AND 1, false) AS ok
  FROM {parts(f"SELECT {key}, {_no_think} AS raw FROM {source}")})"""


def parsed_remote(source: str, key: str) -> str:
    return f"""SELECT {key}, CASE WHEN ok THEN label ELSE 'neutral' END AS sentiment,
  CASE WHEN ok THEN CAST(format('{{:.2f}}', CASE WHEN isnan(v) OR v > 1 THEN 1.0::DOUBLE WHEN v < -1 THEN -1.0::DOUBLE ELSE v END)
    AS DOUBLE) + 0.0 ELSE 0.0 END AS score
FROM (SELECT *, label IN ('positive', 'negative', 'neutral') AND v IS NOT NULL AS ok
  FROM {parts(f"SELECT {key}, lower({_no_think}) AS raw FROM {source}")})"""


ORACLES["parse_local"] = posts_sql(parsed_local("posts", "post_id"))
ORACLES["parse_remote"] = posts_sql(parsed_remote("posts", "post_id"))
ORACLES["parse_remote_decimals"] = parsed_remote(
    "(SELECT doc_id, concat('Positive, ', printf('%.3f', ((n_chars * 7 + doc_id) % 2001 - 1000) / 1000.0::DOUBLE)) AS reply FROM documents)",
    "doc_id",
)
ORACLES["reply_text"] = posts_sql(
    f"""SELECT post_id, CASE WHEN post_id % 6 < 2 THEN coalesce({strip('content')}, '') ELSE '' END AS text,
  CASE WHEN post_id % 6 = 1 THEN coalesce({strip('content')}, '') ELSE '' END AS choice_text,
  CASE WHEN post_id % 6 < 2 AND content IS NULL THEN 'KeyError'
    ELSE [NULL, NULL, NULL, 'TypeError', 'IndexError', 'JSONDecodeError'][post_id % 6 + 1] END AS error,
  CASE WHEN post_id % 6 = 1 AND content IS NULL THEN 'KeyError'
    ELSE ['KeyError', NULL, 'KeyError', 'KeyError', 'IndexError', 'JSONDecodeError'][post_id % 6 + 1] END AS choice_error
  FROM posts"""
)
_head = (
    '{"model":"m","messages":[{"role":"system","content":"' + queries.SYSTEM_TEXT
    + '"},{"role":"user","content":'
)
_tails = {
    "local": '}],"stream":false}',
    "remote": '}],"temperature":0.0,"stream":false}',
    "concurrent": '}],"stream":false,"options":{}}',
    "serial": '}],"temperature":0.2,"max_tokens":512}',
}
ORACLES["model_request"] = posts_sql(
    "SELECT post_id, "
    + ", ".join(
        f"concat({quoted(_head)}, CAST(to_json(coalesce(content, '')) AS VARCHAR), {quoted(tail)}) AS {form}_request"
        for form, tail in _tails.items()
    )
    + " FROM posts"
)
ORACLES["failed_marker"] = posts_sql(
    """SELECT post_id, concat('[翻译失败:Error_', source, '] ', substr(coalesce(content, 'no text'), 1, 160)) AS concurrent,
  concat('[翻译失败:Error_', source, '] ', substr(coalesce(content, 'no text'), 1, 120)) AS serial,
  true AS failed FROM posts"""
)

# --- words ------------------------------------------------------------------------------------
COUNTED = f"""counted AS (
  SELECT word, sentiment, count(*)::BIGINT AS freq FROM (
    SELECT {word_rules('token')} AS word, sentiment FROM (
      SELECT unnest({tokens('cleaned')}) AS token, sentiment
      FROM (SELECT {clean_text('content')} AS cleaned, sentiment FROM posts WHERE content IS NOT NULL)))
  WHERE word IS NOT NULL GROUP BY ALL),
every AS (SELECT word, sum(freq)::BIGINT AS freq FROM counted GROUP BY word)"""
STOP = words_in(fv.CLOUD_STOP_WORDS)
ORACLES["word_freq"] = posts_sql(f"SELECT word, freq FROM every WHERE word NOT IN {STOP}", COUNTED)
ORACLES["positive_word_freq"] = posts_sql(
    f"SELECT word, freq FROM counted WHERE sentiment = 'positive' AND word NOT IN {STOP}", COUNTED
)
for _name, _n in (("wordcloud_input", 500), ("top50_words", 50)):
    ORACLES[_name] = posts_sql(
        f"SELECT word, freq FROM every WHERE word NOT IN {STOP} ORDER BY freq DESC, word LIMIT {_n}", COUNTED
    )
_union = f"""(SELECT unnest([{', '.join(quoted(w) for w in fv.CLOUD_STOP_WORDS)}]) AS word
  UNION SELECT word FROM (SELECT word FROM every ORDER BY freq DESC, word LIMIT 10))"""
ORACLES["stopword_union"] = posts_sql(f"SELECT word FROM {_union}", COUNTED)
ORACLES["stopword_removal"] = posts_sql(
    f"SELECT word, freq FROM every WHERE word NOT IN (SELECT word FROM {_union})", COUNTED
)

# --- routing, resume, enrichment --------------------------------------------------------------
_src = strip("comment")
_is_chinese = (
    f"length(regexp_replace({_src}, '[^一-鿿]', '', 'g')) / length({_src})::DOUBLE > 0.2"
)
_has_target = f"coalesce({strip('translation')}, '') <> ''"
_no_source = f"coalesce({_src}, '') = ''"
ROUTED = f"""routed AS (SELECT comment_id, comment, translation AS old,
  CASE WHEN {_has_target} THEN 'keep' WHEN {_no_source} THEN 'blank' WHEN {_is_chinese} THEN 'copy' ELSE 'send' END AS route,
  CASE WHEN {_has_target} THEN 'keep' WHEN {_no_source} THEN 'blank' ELSE 'send' END AS serial_route FROM comments)"""
_filled = f"CASE route WHEN 'keep' THEN old WHEN 'blank' THEN '' WHEN 'copy' THEN {_src} END"
ORACLES["translation_route"] = with_(COMMENTS, ROUTED) + (
    f"SELECT comment_id, {_filled} AS translation, serial_route, route FROM routed"
)
ORACLES["distinct_requests"] = with_(COMMENTS, ROUTED) + (
    f"SELECT md5({_src}) AS request_key, {_src} AS request, count(*)::BIGINT AS n_rows "
    "FROM routed WHERE route = 'send' GROUP BY 1, 2"
)
ORACLES["translate_comments"] = with_(COMMENTS, ROUTED) + (
    f"""SELECT comment_id, CASE WHEN route <> 'send' THEN {_filled}
  WHEN length({_src}) % 5 = 0 THEN concat('[翻译失败:ValueError] ', substr(concat('cannot translate: ', {_src}), 1, 160))
  ELSE concat('译文 ', length({_src})) END AS translation,
  route = 'send' AND length({_src}) % 5 = 0 AS failed FROM routed"""
)
LOCAL = f"local AS ({parsed_local('posts', 'post_id, content')})"
ORACLES["resume_merge"] = posts_sql(
    """SELECT p.post_id, coalesce(p.sentiment, d.sentiment) AS sentiment, coalesce(p.score, d.score) AS score
FROM posts p LEFT JOIN (SELECT * FROM (SELECT content, sentiment, found AS score,
    row_number() OVER (PARTITION BY content ORDER BY found IS NULL, post_id) AS rn
    FROM (SELECT *, CASE WHEN post_id % 5 <> 0 THEN score END AS found FROM local)
    WHERE sentiment <> 'unknown' AND content IS NOT NULL) WHERE rn = 1) d ON p.content = d.content""",
    LOCAL,
)


def first_reply(c: str) -> str:
    return f"""answers AS (SELECT text, reply FROM (SELECT {c} AS text, reply,
    row_number() OVER (PARTITION BY {c} ORDER BY post_id) AS rn FROM posts) WHERE rn = 1)"""


_open = "p.sentiment IS NULL OR p.score IS NULL"
ORACLES["enrich_local"] = posts_sql(
    f"""SELECT p.post_id, CASE WHEN {_open} THEN a.sentiment ELSE p.sentiment END AS sentiment,
  CASE WHEN {_open} THEN a.score ELSE p.score END AS score
FROM posts p JOIN parsed a ON coalesce(p.content, '') = a.text""",
    first_reply("coalesce(content, '')"),
    f"parsed AS ({parsed_local('answers', 'text')})",
)
_stripped = f"coalesce({strip('content')}, '')"
ORACLES["enrich_remote"] = posts_sql(
    f"""SELECT p.post_id,
  CASE WHEN {_open} THEN CASE WHEN a.text = '' THEN 'neutral' ELSE a.sentiment END ELSE p.sentiment END AS sentiment,
  CASE WHEN {_open} THEN CASE WHEN a.text = '' THEN 0.0 ELSE a.score END ELSE p.score END AS score
FROM (SELECT *, {_stripped} AS key FROM posts) p JOIN parsed a ON p.key = a.text""",
    first_reply(_stripped),
    f"parsed AS ({parsed_remote('answers', 'text')})",
)
_n = "length(coalesce(content, ''))"
ORACLES["enrich_called"] = posts_sql(
    f"""SELECT post_id, CASE WHEN NOT open THEN sentiment WHEN n % 11 = 0 THEN 'unknown'
    ELSE ['positive', 'negative', 'neutral'][n % 3 + 1] END AS sentiment,
  CASE WHEN NOT open THEN score WHEN n % 11 = 0 THEN 0.0 ELSE (n % 100) / 100.0::DOUBLE END AS score
FROM (SELECT *, {_n} AS n, sentiment IS NULL OR score IS NULL AS open FROM posts)"""
)

ORACLES["stream_scores"] = posts_sql(
    f"""SELECT post_id, CASE WHEN n % 11 = 0 THEN 'unknown' ELSE ['positive', 'negative', 'neutral'][n % 3 + 1] END AS sentiment,
  CASE WHEN n % 11 = 0 THEN 0.0 ELSE (n % 100) / 100.0::DOUBLE END AS score FROM (SELECT post_id, {_n} AS n FROM posts)"""
)
ORACLES["stream_answers"] = posts_sql(
    f"""SELECT md5(content) AS request_key, CASE WHEN n % 11 > 0 THEN concat(['positive', 'negative', 'neutral'][n % 3 + 1], ',0.',
    lpad(CAST(n % 100 AS STRING), 2, '0')) END AS reply, CASE WHEN n % 11 = 0 THEN 'TimeoutError' END AS error_type
  FROM (SELECT DISTINCT coalesce(content, '') AS content, {_n} AS n FROM posts)"""
)

# --- bags and windows -------------------------------------------------------------------------
TEXTS = f"""{_ranked},
texts AS (SELECT post_id, lang, {topic_tokens('content')} AS tokens FROM first WHERE rn = 1)"""
BAGS = """bags AS (SELECT post_id, word, count(*)::BIGINT AS n
  FROM (SELECT post_id, unnest(tokens) AS word FROM texts) GROUP BY post_id, word)"""
ORACLES["bag_of_words"] = posts_sql("SELECT * FROM bags", TEXTS, BAGS)
ORACLES["vocabulary"] = posts_sql(
    "SELECT word, sum(n)::BIGINT AS term_freq, count(*)::BIGINT AS doc_freq FROM bags GROUP BY word", TEXTS, BAGS
)
ORACLES["numbered_vocabulary"] = posts_sql(
    """SELECT row_number() OVER (ORDER BY freq DESC, word) - 1 AS term_id, word, freq, texts
    FROM (SELECT word, sum(n)::BIGINT AS freq, count(*)::BIGINT AS texts FROM bags GROUP BY word)""", TEXTS, BAGS
)
ORACLES["topic_mass"] = posts_sql("SELECT word, sum(n)::BIGINT AS mass FROM bags GROUP BY word", TEXTS, BAGS)
# every window of every text that has a listed word, with the listed words it holds
WINDOWS = f"""places AS (SELECT post_id, len(tokens) AS length, unnest(tokens) AS word,
    generate_subscripts(tokens, 1) - 1 AS place FROM texts),
hits AS (SELECT * FROM places WHERE word IN (SELECT word FROM listed)),
held AS (SELECT DISTINCT post_id, word, unnest(range(greatest(place - {fv.COHERENCE_WINDOW - 1}, 0),
    least(place, greatest(length - {fv.COHERENCE_WINDOW}, 0)) + 1)) AS start FROM hits),
whole AS (SELECT sum(greatest(length - {fv.COHERENCE_WINDOW}, 0) + 1)::BIGINT AS windows
  FROM (SELECT DISTINCT post_id, length FROM hits)),
pairs AS (SELECT a.word, b.word AS other, count(*)::BIGINT AS n FROM held a JOIN held b
    ON a.post_id = b.post_id AND a.start = b.start GROUP BY ALL)"""
ORACLES["window_cooccurrence"] = posts_sql(
    "SELECT word, other, n, windows FROM pairs, whole WHERE word <= other",
    TEXTS,
    f"listed AS (SELECT unnest([{', '.join(quoted(w) for w in queries.WINDOW_WORDS)}]) AS word)",
    WINDOWS,
)
ORACLES["coherence_by_lang"] = posts_sql(
    f"""SELECT topic, round(avg(cosine), 6) AS coherence FROM (
  SELECT topic, word, sum(npmi * total) / sqrt(sum(npmi * npmi) * sum(total * total)) AS cosine
  FROM (SELECT *, sum(npmi) OVER (PARTITION BY topic, other) AS total FROM described) GROUP BY topic, word)
GROUP BY topic""",
    TEXTS,
    f"""lists AS (SELECT lang AS topic, word FROM (SELECT lang, word, row_number() OVER
    (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank
    FROM (SELECT lang, unnest(tokens) AS word FROM texts) GROUP BY lang, word) WHERE rank <= {queries.LIST_SIZE}),
listed AS (SELECT DISTINCT word FROM lists)""",
    WINDOWS,
    """joint AS (SELECT word, other, n / windows::DOUBLE AS p FROM pairs, whole),
described AS (SELECT l.topic, l.word, o.word AS other,
    ln((coalesce(j.p, 0) + 1e-12) / (w.p * v.p)) / -ln(coalesce(j.p, 0) + 1e-12) AS npmi
  FROM lists l JOIN lists o ON l.topic = o.topic LEFT JOIN joint j ON j.word = l.word AND j.other = o.word
  JOIN joint w ON w.word = l.word AND w.other = l.word JOIN joint v ON v.word = o.word AND v.other = o.word)""",
)

ORACLES["relevance_by_lang"] = posts_sql(
    """SELECT lang, word, term_freq, round(relevance, 6) AS relevance, round(saliency, 6) AS saliency,
  round(topic_of_word, 6) AS topic_of_word, round(topic_share, 6) AS topic_share
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY relevance DESC, word) AS rank FROM scored) WHERE rank <= 30""",
    TEXTS,
    """counted AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(tokens) AS word FROM texts) GROUP BY ALL),
langs AS (SELECT lang, sum(n) AS n_lang, sum(sum(n)) OVER () AS whole FROM counted GROUP BY lang),
joined AS (SELECT lang, word, n, n_lang, whole, sum(n) OVER (PARTITION BY word) AS term_freq FROM counted JOIN langs USING (lang)),
scored AS (SELECT lang, word, CAST(term_freq AS BIGINT) AS term_freq, n / term_freq AS topic_of_word, n_lang / whole AS topic_share,
  0.6::DOUBLE * ln(n / n_lang) + 0.4::DOUBLE * ln(n / n_lang * whole / term_freq) AS relevance,
  sum(n * ln(n / (term_freq * (n_lang / whole)))) OVER (PARTITION BY word) / whole AS saliency FROM joined)""",
)

_own = "sentiment IS NOT NULL AND score IS NOT NULL"
ORACLES["model_labels"] = posts_sql(
    f"SELECT post_id, CASE WHEN {_own} THEN sentiment END AS own_sentiment, CASE WHEN {_own} THEN score END AS own_score, true AS valid FROM posts"
)

_cost = lambda part, whole: f"-CAST(floor(ln(({part}) / ({whole})) / 1e-6) AS BIGINT)"
_n_of = lambda label, what="*": f"count({what}) FILTER (WHERE sentiment = '{label}')::BIGINT"
LABEL_WORDS = f"""worded AS (SELECT post_id, sentiment, content, unnest({tokens('cleaned')}) AS word
  FROM (SELECT post_id, sentiment, content, {clean_text("coalesce(content, '')")} AS cleaned FROM posts)),
labelled_words AS (SELECT word, count(*)::BIGINT AS n, {', '.join(f'{_n_of(v)} AS {v}' for v in fv.LABELS)}
  FROM worded WHERE content IS NOT NULL AND sentiment IN {words_in(fv.LABELS)} GROUP BY word),
label_sizes AS (SELECT count(*) AS words, {', '.join(f'sum({v}) AS {v}' for v in fv.LABELS)} FROM labelled_words),
label_words AS (SELECT word, n, {', '.join(f"{_cost(f'w.{v} + 1', f's.{v} + s.words')} AS cost_{v}" for v in fv.LABELS)}
  FROM labelled_words w, label_sizes s)"""
ORACLES["label_words"] = posts_sql("SELECT * FROM label_words", LABEL_WORDS)
_sum_of = lambda label: f"coalesce(sum(cost_{label}), 0)::BIGINT + any_value(own_{label}) AS {label}"
_least = f"least({', '.join(fv.LABELS)})"
ORACLES["labels_by_counts"] = posts_sql(
    f"""SELECT p.post_id, CASE WHEN {_own} THEN sentiment ELSE label END AS sentiment, CASE WHEN {_own} THEN score ELSE chance END AS score
FROM posts p JOIN guesses USING (post_id)""",
    LABEL_WORDS,
    f"""shares AS (SELECT {', '.join(f"{_cost(f'{_n_of(v)} + 1', f'count(*) + {len(fv.LABELS)}')} AS own_{v}" for v in fv.LABELS)}
  FROM posts WHERE content IS NOT NULL AND sentiment IN {words_in(fv.LABELS)})""",
    f"""sums AS (SELECT p.post_id, {', '.join(_sum_of(v) for v in fv.LABELS)}
  FROM posts p CROSS JOIN shares LEFT JOIN (SELECT w.post_id, l.* FROM worded w JOIN label_words l USING (word)) m ON p.post_id = m.post_id
  GROUP BY p.post_id)""",
    f"""guesses AS (SELECT post_id, CASE {' '.join(f"WHEN {v} = {_least} THEN '{v}'" for v in fv.LABELS)} END AS label,
  round(1 / ({' + '.join(f'exp(({_least} - {v}) * 1e-6)' for v in fv.LABELS)}), 6) AS chance FROM sums)""",
)
