"""Queries on fuzzy matching, names, roles and answers of language models."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from convolens.functions import fuzzy as Z, jsonfix, text as T
from convolens.operators import names as N, speakers as S
from convolens.plans.base import SEG, seg
from convolens.plans.episodes import EPI, _ep
from convolens.plans.speakers import ORACLE as _SPEAKERS
from convolens.session import table

QUERIES, ORACLE = {}, {}

QUERIES["sanitize_names"] = lambda spark, d: table(spark, d, "shows").select("show", T.sanitize_name(F.col("title")).alias("name"), T.sanitize_name(F.col("title"), 12).alias("short"))
_SAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\\s]', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
ORACLE["sanitize_names"] = f"""WITH x AS (SELECT "show", {_SAN} AS n FROM shows) SELECT "show", CASE WHEN n = '' THEN 'untitled' ELSE n END AS name, CASE WHEN n = '' THEN 'untitled' ELSE regexp_replace(left(n, 12), '_+$', '') END AS short FROM x"""
QUERIES["soundex_codes"] = lambda spark, d: table(spark, d, "part").select("p_partkey", Z.soundex(F.col("p_name")).alias("code"), Z.soundex(F.col("p_brand")).alias("brand_code"))
_SDX = "CASE WHEN {0} = '' THEN '0000' ELSE left(left({0}, 1) || CASE WHEN regexp_matches({0}, '^[AEHIOUWY]') THEN {1} ELSE substr({1}, 2) END || '000', 4) END"


def _runs(w):
    digits = f"regexp_replace(translate({w}, 'BFPVCGJKQSXZDTLMNRAEHIOUWY', '111122222222334556'), '[^0-9]', '', 'g')"
    for x in "123456":
        digits = f"regexp_replace({digits}, '{x}+', '{x}', 'g')"
    return digits


_U = "regexp_replace(upper({0}), '[^A-Z]', '', 'g')"
ORACLE["soundex_codes"] = f"SELECT p_partkey, {_SDX.format(_U.format('p_name'), _runs(_U.format('p_name')))} AS code, {_SDX.format(_U.format('p_brand'), _runs(_U.format('p_brand')))} AS brand_code FROM part"
QUERIES["levenshtein_ratio"] = lambda spark, d: table(spark, d, "customer").select("c_custkey", F.round(Z.levenshtein_ratio(F.col("c_name"), F.col("c_mktsegment")), 6).alias("ratio"))
ORACLE["levenshtein_ratio"] = "SELECT c_custkey, round(CASE WHEN coalesce(length(c_name), 0) = 0 OR coalesce(length(c_mktsegment), 0) = 0 THEN 0 ELSE 1 - levenshtein(c_name, c_mktsegment) / greatest(length(c_name), length(c_mktsegment)) END, 6) AS ratio FROM customer"
QUERIES["titles_match"] = lambda spark, d: _ep(spark, d).join(table(spark, d, "shows").select("show", F.col("title").alias("show_title")), "show").select("episode_id", Z.tokens_match(F.col("title"), F.col("show_title")).alias("match"))
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> ''))"
ORACLE["titles_match"] = f"""WITH {EPI}, j AS (SELECT episode_id, {_TOK.format("e.title")} AS a, {_TOK.format("s.title")} AS b FROM epi e JOIN shows s USING ("show"))
SELECT episode_id, coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0) > 0.5 AS match FROM j"""


def _pairs(spark, d):
    s = table(spark, d, "shows").select("show", "title")
    return s.join(_ep(spark, d).select("show", "episode_id", F.col("title").alias("episode_title")), "show")


def _plain(x: str, expand: bool = True) -> str:
    """SQL for a normalised title. Neighbouring matches share the sign between them, so each replacement is made twice."""
    x = f"lower(coalesce({x}, ''))"
    for short, long in Z.ABBREVIATIONS.items() if expand else ():
        left = "(^|[^\\pL\\pN_])" if short[0].isalnum() else "([\\pL\\pN_])"
        right = "($|[^\\pL\\pN_])" if short[-1].isalnum() else "([\\pL\\pN_])"
        for _ in range(2):
            x = f"regexp_replace({x}, '{left}{short}{right}', '\\1{long}\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in Z.FUZZY_STOPWORDS)


def _side(x: str) -> str:
    """SQL for what scoring needs of one side."""
    plain = _plain(x)
    w = _U.format("w")
    return f"(SELECT {{'plain': p, 'words': ws, 'codes': list_transform(ws, lambda w: {_SDX.format(w, _runs(w))})}} FROM (SELECT p, list_filter(string_split(p, ' '), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})) AS ws FROM (SELECT {plain} AS p)))"


_hits = lambda field: f"list_filter(q.{field}, lambda w: list_contains(t.{field}, w))"
_part = lambda field: f"coalesce(CAST(len({_hits(field)}) AS DOUBLE) / nullif(len(q.{field}), 0), 0e0)"
_CHAR = "CASE WHEN length(q.plain) = 0 OR length(t.plain) = 0 THEN 0e0 ELSE 1 - CAST(levenshtein(q.plain, t.plain) AS DOUBLE) / greatest(length(q.plain), length(t.plain)) END"
_POS = "coalesce(list_sum(list_transform(q.words, lambda w, i: CASE WHEN list_contains(t.words, w) THEN 1e0 / i / (abs(i - list_position(t.words, w)) + 1) ELSE 0e0 END)) / nullif(list_sum(list_transform(q.words, lambda w, i: 1e0 / i)), 0), 0e0)"
_SCORE = f"round(CASE WHEN len(q.words) > 0 AND len(t.words) > 0 THEN least({_part('words')} * 0.4e0 + ({_CHAR}) * 0.3e0 + {_part('codes')} * 0.2e0 + {_POS} * 0.1e0, 1e0) ELSE 0e0 END, 6)"
_PAIRS = f"""{EPI}, pairs AS (SELECT e.episode_id, s."show", s.title AS title, e.title AS episode_title FROM shows s JOIN epi e ON s."show" = e."show")"""
ORACLE["fuzzy_scores"] = f"""WITH {_PAIRS}, sides AS (SELECT episode_id, {_side("title")} AS q, {_side("episode_title")} AS t FROM pairs),
r AS (SELECT *, concat_ws('; ', CASE WHEN {_part("words")} > 0.3 THEN 'matched words: ' || array_to_string({_hits("words")}, ', ') END, CASE WHEN {_part("codes")} > {_part("words")} THEN 'phonetic similarity detected' END, CASE WHEN {_POS} > 0.5 THEN 'good word ordering' END) AS said FROM sides)
SELECT episode_id, {_SCORE} AS score, CASE WHEN len(q.words) = 0 THEN 'no significant words in query' WHEN len(t.words) = 0 THEN 'no significant words in target' WHEN said = '' THEN 'low match confidence' ELSE said END AS explanation FROM r"""
ORACLE["query_variations"] = f"""WITH v AS (SELECT "show", list_filter([title, CASE WHEN {_plain("title", False)} <> lower(title) THEN {_plain("title", False)} END, {_plain("title")}, CASE WHEN NOT contains(lower(title), 'podcast') THEN title || ' podcast' END,
  CASE WHEN contains(lower(title), 'podcast') AND trim(regexp_replace(title, '\\s*podcast\\s*', ' ', 'gi')) <> '' THEN trim(regexp_replace(title, '\\s*podcast\\s*', ' ', 'gi')) END,
  CASE WHEN starts_with(lower(title), 'the ') AND length(title) > 4 THEN substr(title, 5) END,
  CASE WHEN lower(regexp_split_to_array(trim(title), '\\s+')[1]) NOT IN ('the', 'a', 'an') AND trim(title) <> '' THEN 'the ' || title END], lambda x: x IS NOT NULL) AS l FROM shows)
SELECT "show", array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS variations FROM v"""
ORACLE["video_confidence"] = f"""WITH {_PAIRS}, v AS (SELECT episode_id, lower(title) AS s, lower(title || ' ' || episode_title) AS t, lower(episode_title) AS e, length(episode_title) * 50 AS dur FROM pairs),
w AS (SELECT *, list_filter(regexp_split_to_array(e, '\\s+'), lambda x: length(x) > 2) AS wanted FROM v)
SELECT episode_id, round(least(CASE WHEN contains(t, s) OR contains('x', s) THEN 0.4e0 WHEN len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: length(x) > 3 AND contains(t, x))) > 0 THEN 0.2e0 ELSE 0e0 END
  + coalesce(CAST(len(list_filter(wanted, lambda x: list_contains(regexp_split_to_array(t, '\\s+'), x))) AS DOUBLE) / nullif(len(wanted), 0), 0e0) * 0.4e0
  + CASE WHEN dur > 0 AND abs(1000 - dur) <= 100 THEN 0.2e0 WHEN dur > 0 AND abs(1000 - dur) <= 250 THEN 0.1e0 ELSE 0e0 END, 1e0), 6) AS score FROM w"""
QUERIES["fuzzy_scores"] = lambda spark, d: _pairs(spark, d).select("episode_id", Z.prepared(F.col("title")).alias("q"), Z.prepared(F.col("episode_title")).alias("t")).select("episode_id", F.round(Z.score_of(F.col("q"), F.col("t")), 6).alias("score"), Z.explanation_of(F.col("q"), F.col("t")).alias("explanation"))
QUERIES["query_variations"] = lambda spark, d: table(spark, d, "shows").select("show", F.array_join(Z.query_variations(F.col("title")), "|").alias("variations"))
QUERIES["video_confidence"] = lambda spark, d: _pairs(spark, d).select("episode_id", F.round(Z.video_confidence(F.col("episode_title"), F.lit(1000), F.col("title"), F.concat(F.col("title"), F.lit(" "), F.col("episode_title")), F.lit("x"), F.length("episode_title") * 50), 6).alias("score"))
_ERR = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{'|'.join(words)}') THEN '{name}'" for name, words in Z.ERRORS) + " ELSE 'unknown' END"
_MSG = "['Connection reset', 'request timed out', 'HTTP 404', 'blocked by host', 'corrupt file', 'quota reached', 'odd', 'ssl timeout']"
QUERIES["error_categories"] = lambda spark, d: table(spark, d, "events").select("event_type", F.element_at(F.array(*map(F.lit, ("Connection reset", "request timed out", "HTTP 404", "blocked by host", "corrupt file", "quota reached", "odd", "ssl timeout"))), (F.col("event_id") % 8 + 1).cast("int")).alias("x"), F.element_at(F.array(*map(F.lit, (404, 403, 429, 418, 503, 700))), (F.col("event_id") % 6 + 1).cast("int")).alias("status")).select(Z.error_category(F.col("x")).alias("category"), Z.http_category(F.col("status")).alias("http")).groupBy("category", "http").agg(F.count("*").alias("n"))
ORACLE["error_categories"] = f"""WITH e AS (SELECT {_MSG}[event_id % 8 + 1] AS x, [404, 403, 429, 418, 503, 700][event_id % 6 + 1] AS s FROM events)
SELECT {_ERR} AS category, CASE WHEN s = 404 THEN 'not_found' WHEN s = 403 THEN 'permission' WHEN s = 429 THEN 'rate_limit' WHEN s BETWEEN 400 AND 499 THEN 'client' WHEN s BETWEEN 500 AND 599 THEN 'network' ELSE 'http' END AS http, count(*) AS n FROM e GROUP BY ALL"""

# names: the texts introduce nobody, so each speaker's first segment of an episode gets an introduction before its text
def _introduced(spark, d):
    s = seg(spark, d)
    first = F.min("segment_id").over(W.partitionBy("episode_id", "speaker"))
    hello = F.concat(F.lit("Welcome. My name is "), F.regexp_replace("speaker_name", r"\s+", " Q. "), F.lit(" and this is the show. "))
    return s.withColumn("text", F.when((F.col("segment_id") == first) & F.col("speaker_name").isNotNull(), F.concat(hello, "text")).otherwise(F.col("text")))


def _valid(x: str) -> str:
    """SQL for whether a text is a name."""
    ws = f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '')"
    return f"(len({ws}) BETWEEN 2 AND 5 AND len(list_filter({ws}, lambda w: regexp_full_match(w, '.\\.') OR (length(w) >= 2 AND regexp_matches(w, '^\\p{{Lu}}')))) = len({ws}) AND lower({x}) NOT IN ({', '.join(repr(n) for n in N.NO_NAMES)}))"


_quote = lambda p: p.replace("'", "''")
_HELLO = f"""{SEG}, hi AS (SELECT episode_id, segment_id, speaker, CASE WHEN segment_id = min(segment_id) OVER (PARTITION BY episode_id, speaker) AND speaker_name IS NOT NULL
  THEN 'Welcome. My name is ' || regexp_replace(speaker_name, '\\s+', ' Q. ', 'g') || ' and this is the show. ' || text ELSE text END AS text FROM seg)"""
_FOUND = _HELLO + ", found AS (" + " UNION ALL ".join(f"SELECT episode_id, segment_id, speaker, unnest(regexp_extract_all(text, '{_quote(p)}', 1)) AS name, {i} AS pattern_no FROM hi" for i, p in enumerate(N.INTRODUCTIONS)) + ")"
QUERIES["introduced_names"] = lambda spark, d: N.introduced_names(_introduced(spark, d), ["episode_id", "segment_id"])
ORACLE["introduced_names"] = f"WITH {_FOUND} SELECT episode_id, segment_id, name, pattern_no, 0.85e0 AS confidence FROM found WHERE {_valid('name')}"
QUERIES["names_by_speaker"] = lambda spark, d: N.names_by_speaker(_introduced(spark, d))
ORACLE["names_by_speaker"] = f"""WITH {_FOUND}, v AS (SELECT *, lower(trim(name)) AS k FROM found WHERE {_valid("name")}),
f AS (SELECT episode_id, speaker, k, arg_min({{'p': segment_id, 'n': name, 'm': pattern_no}}, {{'p': segment_id, 'n': name, 'm': 'pattern_' || pattern_no}}) AS f FROM v GROUP BY ALL),
o AS (SELECT v.episode_id, v.speaker, v.k, count(*) FILTER (v.pattern_no <> f.f.m) AS others, any_value(f.f) AS f FROM v JOIN f ON v.episode_id = f.episode_id AND v.speaker = f.speaker AND v.k = f.k GROUP BY ALL)
SELECT episode_id, speaker, f.n AS name, CASE WHEN others > 0 THEN 'combined' ELSE 'pattern_' || f.m END AS method, CASE WHEN others > 0 THEN 0.95e0 ELSE 0.85e0 END AS confidence, f.p AS position FROM o"""
_SANITY = lambda x: f"(CASE WHEN {_SAN.replace('title', x)} = '' THEN 'untitled' ELSE {_SAN.replace('title', x)} END)"


def names_sql(filename: str) -> str:
    """SQL for the names in a file name."""
    stem = f"regexp_replace(regexp_replace({filename}, '\\.[^.]*$', ''), '^\\d+_?', '')"
    marked = f"array_to_string(list_transform(list_filter(regexp_split_to_array({stem}, '[_\\-\\s]+'), lambda w: w <> ''), lambda w: CASE WHEN lower(w) IN ({', '.join(repr(w) for w in N.SKIP_WORDS)}) THEN '|' ELSE w END), ' ')"
    title = "array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(g, '\\s+', ' ', 'g')), '([\\pL]+|[^\\pL]+)', 1), lambda p: upper(left(p, 1)) || lower(substr(p, 2))), '')"
    return f"list_filter(list_transform(string_split({marked}, '|'), lambda g: {title}), lambda n: {_valid('n')})"


ORACLE["filename_names"] = f"""WITH {EPI} SELECT episode_id, array_to_string({names_sql("'12_' || " + _SANITY("title") + " || '_with_' || " + _SANITY('"show"') + " || '.json'")}, ';') AS names FROM epi"""
QUERIES["filename_names"] = lambda spark, d: _ep(spark, d).select("episode_id", F.array_join(N.names_in_filename(F.concat(F.lit("12_"), T.sanitize_name(F.col("title")), F.lit("_with_"), T.sanitize_name(F.col("show")), F.lit(".json"))), ";").alias("names"))


def _episodes_with_names(spark, d):
    people = seg(spark, d).where("speaker_name is not null").groupBy("episode_id").agg(F.array_sort(F.collect_set("speaker_name")).alias("names"))
    shows = table(spark, d, "shows").select("show", F.col("title").alias("show_title"), F.col("author").alias("known_host"))
    intro = seg(spark, d).where("segment_id < 30").groupBy("episode_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "text"))), lambda x: x["text"]), " ").alias("intro"))
    return _ep(spark, d).select("episode_id", "show", "title").join(people, "episode_id").join(shows, "show").join(intro, "episode_id", "left")


QUERIES["role_assign"] = lambda spark, d: N.heuristic_roles(_episodes_with_names(spark, d))
QUERIES["role_fallback"] = lambda spark, d: N.fallback_roles(_episodes_with_names(spark, d))
_intro_sql = """SELECT episode_id, string_agg(text, ' ' ORDER BY segment_id) AS intro FROM seg WHERE segment_id < 30 GROUP BY 1"""
ORACLE["role_assign"] = f"""WITH RECURSIVE {EPI}, {SEG}, pe AS (SELECT DISTINCT episode_id, speaker_name AS name FROM seg WHERE speaker_name IS NOT NULL), it AS ({_intro_sql}),
po AS (SELECT pe.episode_id, CAST(row_number() OVER (PARTITION BY pe.episode_id ORDER BY name) - 1 AS INT) AS ord, name, coalesce(lower(name) = lower(s.author), false) AS known,
  contains(lower(replace(coalesce(s.title, ''), '_', ' ')), lower(name)) AS in_show, contains(lower(coalesce(e.title, '')), lower(name)) AS in_title,
  contains(lower(coalesce(intro, '')), 'i''m ' || lower(name)) OR contains(lower(coalesce(intro, '')), 'my name is ' || lower(name)) AS said
  FROM pe JOIN epi e USING (episode_id) JOIN shows s ON s."show" = e."show" LEFT JOIN it ON it.episode_id = pe.episode_id),
r AS (SELECT po.*, known OR in_show OR (NOT in_title AND said) AS host, known OR in_show AS by_show FROM po WHERE ord = 0
  UNION ALL SELECT po.*, r.host OR po.known OR (NOT r.host AND po.in_show) OR (NOT po.in_title AND po.said AND NOT r.host), po.known OR (NOT r.host AND po.in_show) FROM r JOIN po ON po.episode_id = r.episode_id AND po.ord = r.ord + 1),
h AS (SELECT *, coalesce(lag(host) OVER (PARTITION BY episode_id ORDER BY ord), false) AS had FROM r)
SELECT episode_id, ord, name, CASE WHEN by_show THEN 'HOST' WHEN in_title THEN 'GUEST' WHEN said AND NOT had THEN 'HOST' ELSE 'GUEST' END AS role, CASE WHEN known THEN 0.95e0 WHEN by_show THEN 0.8e0 WHEN in_title THEN 0.75e0 WHEN said THEN 0.7e0 ELSE 0.5e0 END AS confidence,
  CASE WHEN known THEN 'known host' WHEN by_show THEN 'in podcast title' WHEN in_title THEN 'in episode title' WHEN said THEN 'self-introduction' ELSE 'default' END AS reason FROM h"""
_PEOPLE = f"""{EPI}, {SEG}, pe AS (SELECT DISTINCT episode_id, speaker_name AS name FROM seg WHERE speaker_name IS NOT NULL), po AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY name) - 1 AS ord FROM pe)"""
ORACLE["role_fallback"] = f"""WITH {_PEOPLE}, j AS (SELECT episode_id, ord, name, contains(lower(replace(coalesce(s.title, ''), '_', ' ')), lower(name)) AS hit FROM po JOIN epi e USING (episode_id) JOIN shows s ON s."show" = e."show"),
f AS (SELECT *, min(CASE WHEN hit THEN ord END) OVER (PARTITION BY episode_id) AS first FROM j) SELECT episode_id, CAST(ord AS INT) AS ord, name, CASE WHEN ord = first THEN 'HOST' ELSE 'GUEST' END AS role, CASE WHEN ord = first THEN 0.6 ELSE 0.4 END AS confidence FROM f"""
_mapped = lambda spark, d: N.label_speakers(_episodes_with_names(spark, d), seg(spark, d), S.host_candidates(seg(spark, d)))
QUERIES["name_mapping"] = _mapped
_SELF_SQL = " UNION ALL ".join(f"SELECT episode_id, i, speaker, lower(regexp_extract(text, '(?i){_quote(p)}', 1)) AS name FROM early WHERE i <= 30" for p in N.SELF_INTRODUCTIONS)
# names take speakers one after another, so the free speakers are carried from one name to the next
_MAPPED = f"""WITH RECURSIVE {SEG}, ra AS ({ORACLE["role_assign"]}), hc AS ({_SPEAKERS["host_candidate"]}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY segment_id) AS i FROM seg), early AS (SELECT * FROM numbered WHERE i <= 64),
sp AS (SELECT episode_id, speaker, min(segment_id) AS first, sum(greatest(end_ms - start_ms, 0)) AS ms FROM seg GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, first) - 1 AS rank FROM sp),
al AS (SELECT episode_id, list(speaker ORDER BY first) AS free, list(speaker ORDER BY rank) AS ranked FROM rk GROUP BY 1),
claims AS ({_SELF_SQL}),
own AS (SELECT ra.episode_id, ra.ord, list(c.speaker ORDER BY c.i) AS l FROM ra JOIN claims c ON c.episode_id = ra.episode_id AND c.name = lower(ra.name) GROUP BY ALL),
after AS (SELECT episode_id, i, speaker, text, list(speaker) OVER (PARTITION BY episode_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS nxt FROM early),
other AS (SELECT ra.episode_id, ra.ord, list({{'a': a.speaker, 'b': list_filter(a.nxt, lambda x: x <> '' AND x <> a.speaker)[1]}} ORDER BY a.i) AS l FROM ra JOIN after a ON a.episode_id = ra.episode_id AND a.i <= 60 AND contains(lower(a.text), lower(ra.name)) GROUP BY ALL),
q AS (SELECT ra.*, row_number() OVER (PARTITION BY ra.episode_id ORDER BY CASE role WHEN 'HOST' THEN 0 WHEN 'GUEST' THEN 1 ELSE 2 END, confidence DESC, ra.ord) AS k, own.l AS own, other.l AS other, hc.rank AS host_rank
  FROM ra LEFT JOIN own ON own.episode_id = ra.episode_id AND own.ord = ra.ord LEFT JOIN other ON other.episode_id = ra.episode_id AND other.ord = ra.ord JOIN epi e ON e.episode_id = ra.episode_id LEFT JOIN hc ON hc."show" = e."show" AND hc.score > 0.5),
step AS (
  SELECT episode_id, CAST(0 AS BIGINT) AS k, free, ranked, CAST(NULL AS VARCHAR) AS speaker, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS method FROM al
  UNION ALL
  SELECT episode_id, k, list_filter(free, lambda x: x <> c.s), ranked, c.s, name, role, round(c.conf, 6), c.m FROM (
    SELECT s.episode_id, q.k, s.free, s.ranked, q.name, q.role, CASE
      WHEN list_filter(q.own, lambda x: list_contains(s.free, x))[1] IS NOT NULL THEN {{'s': list_filter(q.own, lambda x: list_contains(s.free, x))[1], 'conf': least(0.9e0, q.confidence + 0.2e0), 'm': 'self_introduction'}}
      WHEN list_filter(q.other, lambda x: list_contains(s.free, x.a) AND list_contains(s.free, x.b))[1] IS NOT NULL THEN {{'s': list_filter(q.other, lambda x: list_contains(s.free, x.a) AND list_contains(s.free, x.b))[1].b, 'conf': least(0.85e0, q.confidence + 0.1e0), 'm': 'direct_mention'}}
      WHEN q.role = 'HOST' AND q.host_rank IS NOT NULL AND list_contains(s.free, s.ranked[q.host_rank + 1]) THEN {{'s': s.ranked[q.host_rank + 1], 'conf': least(0.75e0, q.confidence), 'm': 'cross_episode_pattern'}}
      WHEN q.role = 'HOST' AND list_contains(s.free, s.ranked[1]) THEN {{'s': s.ranked[1], 'conf': least(0.6e0, q.confidence), 'm': 'speaking_time_rank'}}
      WHEN q.role = 'GUEST' AND list_contains(s.free, s.ranked[2]) THEN {{'s': s.ranked[2], 'conf': least(0.5e0, q.confidence), 'm': 'speaking_time_rank'}}
      ELSE {{'s': s.free[1], 'conf': 0.3e0, 'm': 'fallback'}} END AS c
    FROM step s JOIN q ON q.episode_id = s.episode_id AND q.k = s.k + 1 WHERE len(s.free) > 0)),
mp AS (SELECT episode_id, speaker, name, role, confidence, method FROM step WHERE k > 0)"""
_MAPPED = _MAPPED.replace(f"WITH RECURSIVE {SEG}, ra", f"WITH RECURSIVE {EPI}, {SEG}, ra", 1)
ORACLE["name_mapping"] = f"{_MAPPED} SELECT * FROM mp"
QUERIES["labeling_summary"] = lambda spark, d: N.labeling_summary(_mapped(spark, d))
ORACLE["labeling_summary"] = f"""{_MAPPED} SELECT 'method' AS dimension, method AS value, count(*) AS n, round(avg(confidence), 4) AS avg_confidence FROM mp GROUP BY 2 UNION ALL SELECT 'role', role, count(*), round(avg(confidence), 4) FROM mp GROUP BY 2
UNION ALL SELECT 'all', 'all', count(*), round(avg(confidence), 4) FROM mp"""
QUERIES["name_sources"] = lambda spark, d: N.first_source_names(seg(spark, d).where("speaker_name is not null").select("episode_id", F.when(F.col("segment_id") % 2 == 0, F.upper("speaker_name")).otherwise(F.col("speaker_name")).alias("name"), (F.col("segment_id") % 2).alias("priority")).distinct(), ["episode_id"])
ORACLE["name_sources"] = f"""WITH {SEG}, c AS (SELECT DISTINCT episode_id, CASE WHEN segment_id % 2 = 0 THEN upper(speaker_name) ELSE speaker_name END AS name, segment_id % 2 AS priority FROM seg WHERE speaker_name IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, lower(name) ORDER BY priority, name) AS r FROM c) SELECT episode_id, name, priority FROM r WHERE r = 1"""

# single column functions, each over its whole table
QUERIES["show_names"] = lambda spark, d: table(spark, d, "transcripts").select("audio_file", T.extract_show_name(F.concat(F.lit("root/"), "show", F.lit("/"), "audio_file")).alias("deep"), T.extract_show_name(F.col("audio_file")).alias("own"))
ORACLE["show_names"] = """WITH p AS (SELECT audio_file, string_split('root/' || "show" || '/' || audio_file, '/') AS a, string_split(audio_file, '/') AS b FROM transcripts)
SELECT audio_file, CASE WHEN len(a) >= 3 THEN a[-2] ELSE 'unknown' END AS deep, CASE WHEN len(b) >= 3 THEN b[-2] ELSE 'unknown' END AS own FROM p"""
QUERIES["plain_markup"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.strip_markup(F.col("text")).alias("text"))
ORACLE["plain_markup"] = "SELECT doc_id, regexp_replace(text, '\\[/?[^\\]]+\\]', '', 'g') AS text FROM documents"
QUERIES["valid_names"] = lambda spark, d: table(spark, d, "segments").select("speaker_name").distinct().select("speaker_name", N.is_valid_name(F.col("speaker_name")).alias("valid"))
ORACLE["valid_names"] = f"""SELECT DISTINCT speaker_name, CASE WHEN speaker_name IS NOT NULL THEN {_valid("speaker_name")} END AS valid FROM segments"""
QUERIES["fuzzy_parts"] = lambda spark, d: _pairs(spark, d).select("episode_id", Z.prepared(F.col("title")).alias("q"), Z.prepared(F.col("episode_title")).alias("t")).select("episode_id", *(F.round(v, 6).alias(k) for k, v in Z.parts_of(F.col("q"), F.col("t")).items()), F.array_join("q.words", " ").alias("words"), F.col("t.plain").alias("plain"))
ORACLE["fuzzy_parts"] = f"""WITH {_PAIRS}, sides AS (SELECT episode_id, {_side("title")} AS q, {_side("episode_title")} AS t FROM pairs)
SELECT episode_id, round({_part("words")}, 6) AS word, round({_CHAR}, 6) AS char, round({_part("codes")}, 6) AS phonetic, round({_POS}, 6) AS position, array_to_string(q.words, ' ') AS words, t.plain AS plain FROM sides"""
QUERIES["show_filter"] = lambda spark, d: S.speaker_stats(seg(spark, d).where(F.lower("show").rlike("^[a-m]"))).select("show", "episode_id", "speaker", "n_segments")
ORACLE["show_filter"] = f"""WITH {SEG} SELECT "show", episode_id, speaker, count(*) AS n_segments FROM seg WHERE regexp_matches(lower("show"), '^[a-m]') GROUP BY ALL"""

_ANSWERS = [
    '```json\n{"has_hate_speech": true, "target_group": "women", "hate_speech_type": "slurs", "main_topic": "news",}\n```',
    "{'has_hate_speech': False, 'has_advertisement': True, 'target_group': None}", 'Sure. {"has_hate_speech": true, "main_topic": "a {b} c"} more {x}', "{has_hate_speech: True, main_topic: 'a'}", "no", "", '{"has_hate_speech": tru',
]


def json_repair(spark, d):
    texts = F.array(*map(F.lit, _ANSWERS))
    e = table(spark, d, "events").select("event_id", F.element_at(texts, (F.col("event_id") % len(_ANSWERS) + 1).cast("int")).alias("answer"))
    return e.select("event_id", jsonfix.parse_annotation(F.col("answer")).alias("a")).select("event_id", "a.*")


QUERIES["json_repair"] = json_repair
# what a person reads out of each answer
_READ = [
    ("true", "false", "'women'", "'slurs'", "'news'", "NULL"), ("false", "true", "NULL", "NULL", "NULL", "NULL"), ("true", "false", "NULL", "NULL", "'a {b} c'", "NULL"), ("true", "false", "NULL", "NULL", "'a'", "NULL"),
    ("NULL", "NULL", "NULL", "NULL", "NULL", "'no JSON object'"), ("NULL", "NULL", "NULL", "NULL", "NULL", "'empty response'"), ("NULL", "NULL", "NULL", "NULL", "NULL", "'no JSON object'"),
]
ORACLE["json_repair"] = "WITH r(i, h, a, g, t, m, e) AS (VALUES " + ", ".join(f"({i}, {', '.join(x)})" for i, x in enumerate(_READ)) + f") SELECT event_id, h AS has_hate_speech, a AS has_advertisement, g AS target_group, t AS hate_speech_type, m AS main_topic, e AS error FROM events JOIN r ON event_id % {len(_READ)} = r.i"
