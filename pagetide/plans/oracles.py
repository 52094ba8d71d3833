"""The same questions in plain SQL, for an engine that shares no code with the operators.

Each statement is written from the definition of the question, in the simplest form, not from
the way the operator answers it.
"""

from __future__ import annotations

# --- shared parts -----------------------------------------------------------------------

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"

_RUNS = """
runs AS (
  SELECT user_id AS feed_id, event_id AS run_id, ts AS started_at,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'not_modified' ELSE 'ok' END AS status,
         CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 304 ELSE 200 END AS http_status,
         CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS n_new,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_type <> 'error' THEN NULL
              WHEN value < 20 THEN 'FetchError: HTTP 503'
              WHEN value < 40 THEN 'FeedParseError: flux illisible'
              ELSE 'TypeError: valeur' END AS error_message,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 THEN 'suspected'
              WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 THEN 'none'
              ELSE 'unknown' END AS gap_status
  FROM events WHERE event_type <> 'signup'
),
attempts AS (SELECT ts AS attempted_at FROM events WHERE event_type = 'signup'),
feeds AS (
  SELECT DISTINCT user_id AS feed_id, 'feed-' || user_id AS slug, user_id % 10 <> 9 AS is_active,
         CASE WHEN user_id % 2 = 0 THEN 'fr' ELSE 'en' END AS lang,
         ['ai', 'sec', 'both'][user_id % 3 + 1] AS topic,
         ['media', 'vendor', 'official', 'community'][user_id % 4 + 1] AS source_type
  FROM events
)"""

_INTERVALS = (
    _RUNS
    + f""",
closing AS (SELECT feed_id, started_at FROM runs WHERE status IN ('ok', 'not_modified')),
intervals AS (
  SELECT feed_id, started_at AS start_at,
         coalesce(lead(started_at) OVER w, {_NOW}) AS end_at,
         lead(started_at) OVER w IS NULL AS ongoing
  FROM closing WINDOW w AS (PARTITION BY feed_id ORDER BY started_at)
),
measured AS (
  SELECT *, epoch_us(end_at) - epoch_us(start_at) AS length_us,
         epoch_us(end_at) - epoch_us(start_at) > 2 * 6 * 3600000000 AS is_gap
  FROM intervals
),
counted AS (
  SELECT m.*, (SELECT count(*) FROM attempts a WHERE a.attempted_at > m.start_at AND a.attempted_at <= m.end_at)
              AS missed_attempts
  FROM measured m WHERE is_gap
),
per_feed AS (
  SELECT feed_id, count(*) AS n_runs, min(start_at) AS first_run, max(start_at) AS last_run,
         median(length_us) FILTER (WHERE NOT ongoing) AS median_interval_us,
         max(length_us) AS worst_interval_us,
         count(*) FILTER (WHERE is_gap) AS n_gaps,
         bool_or(is_gap AND ongoing) AS has_ongoing_gap
  FROM measured GROUP BY feed_id
),
suspected AS (
  SELECT feed_id, count(*) AS n_suspected FROM runs WHERE gap_status = 'suspected' GROUP BY feed_id
),
feed_rows AS (
  SELECT f.feed_id, f.slug, f.is_active, coalesce(p.n_runs, 0) AS n_runs, p.first_run, p.last_run,
         p.median_interval_us, p.worst_interval_us, coalesce(p.n_gaps, 0) AS n_gaps,
         coalesce(p.has_ongoing_gap, false) AS has_ongoing_gap, coalesce(p.n_runs, 0) >= 3 AS observed,
         coalesce(s.n_suspected, 0) AS n_suspected
  FROM feeds f LEFT JOIN per_feed p USING (feed_id) LEFT JOIN suspected s USING (feed_id)
)"""
)


def _paris(stamp: str) -> str:
    return f"timezone('Europe/Paris', timezone('UTC', {stamp}))"


def _absolute(stamp: str) -> str:
    return f"strftime({_paris(stamp)}, '%d/%m/%Y %H:%M')"


def _attribute(stamp: str) -> str:
    minutes = f"CAST(date_diff('minute', {stamp}, {_paris(stamp)}) AS BIGINT)"
    return (
        f"strftime({_paris(stamp)}, '%Y-%m-%dT%H:%M') || '+' || "
        f"lpad(CAST({minutes} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({minutes} % 60 AS VARCHAR), 2, '0')"
    )


def _relative(age_us: str, stamp: str) -> str:
    return f"""CASE WHEN {age_us} < 60000000 THEN 'à l''instant'
      WHEN {age_us} < 3600000000 THEN 'il y a ' || ({age_us}) // 60000000 || ' min'
      WHEN {age_us} < 86400000000 THEN 'il y a ' || ({age_us}) // 3600000000 || ' h'
      WHEN {age_us} < 2 * 86400000000 THEN 'hier'
      WHEN {age_us} < 7 * 86400000000 THEN 'il y a ' || ({age_us}) // 86400000000 || ' jours'
      WHEN {age_us} < 60 * 86400000000 THEN 'il y a ' || ({age_us}) // (7 * 86400000000) || ' sem.'
      ELSE {_absolute(stamp)} END"""


def _duration(us: str) -> str:
    minutes = f"(({us}) // 60000000)"
    return f"""CASE WHEN ({us}) IS NULL THEN '—'
      WHEN ({us}) // 1000000 < 60 THEN ({us}) // 1000000 || ' s'
      WHEN {minutes} < 60 THEN {minutes} || ' min'
      WHEN {minutes} < 2880 THEN replace(printf('%.1f', CAST({minutes} AS DOUBLE) / 60) || ' h', '.0 ', ' ')
      ELSE replace(printf('%.1f', CAST({minutes} AS DOUBLE) / 60 / 24) || ' j', '.0 ', ' ') END"""


def _labels(column: str, pairs: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return f"CASE {column} {whens} ELSE {default} END"


_LANG = _labels("lang", {"fr": "FR", "en": "EN"}, "upper(lang)")
_TOPIC = _labels("topic", {"ai": "IA", "sec": "Cyber", "both": "IA + Cyber"}, "topic")
_SOURCE = _labels(
    "source_type",
    {"media": "média", "vendor": "éditeur", "official": "officiel", "community": "communauté"},
    "source_type",
)
_GAP = _labels(
    "gap_status", {"none": "aucun trou", "suspected": "trou suspecte", "unknown": "indetermine"}, "''"
)
_KIND = """CASE WHEN error_message LIKE 'FetchError:%' THEN 'reseau'
  WHEN error_message LIKE 'FeedParseError:%' THEN 'flux'
  WHEN regexp_matches(error_message, '^[A-Za-z]*Error:') THEN 'interne' ELSE '' END"""
_KIND_LABEL = f"CASE {_KIND} WHEN 'reseau' THEN 'réseau' WHEN 'flux' THEN 'flux' WHEN 'interne' THEN 'interne' ELSE '' END"

_ARTICLES = """
articles AS (
  SELECT 'https://docs.example/' || doc_id AS url_canonical,
         CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS first_feed_id,
         doc_id AS first_seq, 'Document ' || doc_id AS title, text AS summary_clean,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id // 10) AS published_at,
         CASE WHEN lang = 'de' THEN 'fetched' ELSE 'published' END AS date_source
  FROM documents
),
doc_feeds AS (
  SELECT DISTINCT first_feed_id AS feed_id, 'feed-' || first_feed_id AS slug,
         'Feed ' || first_feed_id AS name,
         CASE WHEN first_feed_id % 2 = 0 THEN 'fr' ELSE 'en' END AS lang,
         ['ai', 'sec', 'both'][first_feed_id % 3 + 1] AS topic
  FROM articles
)"""

_HEALTH = (
    _RUNS
    + ","
    + _ARTICLES
    + """,
health AS (
  SELECT f.*, r.started_at, r.status, r.http_status, r.n_new, r.k, r.error_message, r.gap_status,
         coalesce(c.n_articles, 0) AS n_articles
  FROM feeds f
  LEFT JOIN (SELECT feed_id, max(started_at) AS started_at FROM runs GROUP BY feed_id) l USING (feed_id)
  LEFT JOIN runs r ON r.feed_id = l.feed_id AND r.started_at = l.started_at
  LEFT JOIN (SELECT first_feed_id, count(*) AS n_articles FROM articles GROUP BY first_feed_id) c
    ON c.first_feed_id = f.feed_id
)"""
)

_OBS = """
obs AS (
  SELECT l_suppkey AS feed_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS run_id,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS seq,
         l_shipdate AS seen_at, CAST(l_partkey AS VARCHAR) AS url_canonical,
         concat_ws('/', 'https://part', l_partkey, l_orderkey) AS url_original,
         CASE WHEN l_linenumber > 1 THEN CAST(l_orderkey AS VARCHAR) END AS guid,
         concat_ws(' ', 'Part', l_partkey, l_returnflag, l_linestatus) AS title,
         o_orderpriority AS author, l_returnflag || l_linestatus AS content_hash,
         o_orderdate AS published_at,
         CASE WHEN l_quantity > 40 THEN 'fetched' ELSE 'published' END AS date_source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

_FOLD = (
    _OBS
    + """,
paged AS (
  SELECT *, row_number() OVER (PARTITION BY feed_id, run_id, url_canonical ORDER BY seq) AS nth FROM obs
),
kept AS (
  SELECT *, content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY url_canonical ORDER BY seq)
            OR row_number() OVER (PARTITION BY url_canonical ORDER BY seq) = 1 AS changed
  FROM paged WHERE nth = 1
),
article AS (
  SELECT url_canonical, arg_min(feed_id, seq) AS first_feed_id,
         arg_max(title, seq) FILTER (WHERE changed) AS title,
         arg_max(author, seq) FILTER (WHERE changed) AS author,
         arg_max(content_hash, seq) FILTER (WHERE changed) AS content_hash,
         arg_min(published_at, seq) AS published_at, arg_min(date_source, seq) AS date_source,
         arg_min(seen_at, seq) AS first_seen_at, arg_max(seen_at, seq) AS last_seen_at,
         arg_max(seen_at, seq) FILTER (WHERE changed) AS updated_at, count(*) AS n_observations
  FROM kept GROUP BY url_canonical
)"""
)

_ARTICLE_ROWS = (
    "WITH "
    + _FOLD
    + """
SELECT url_canonical, first_feed_id, title, author, content_hash, epoch_us(published_at) AS published_at_us,
       date_source, epoch_us(first_seen_at) AS first_seen_at_us, epoch_us(last_seen_at) AS last_seen_at_us,
       epoch_us(updated_at) AS updated_at_us, n_observations
FROM article"""
)

_ENTRIES = """
entries AS (
  SELECT user_id AS feed_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 604800000000 AS run_id,
         row_number() OVER (ORDER BY ts, event_id) AS seq, ts, event_type,
         (user_id % 10) || '-' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS url,
         ts - to_hours(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS published_at,
         event_type <> 'error' AS reliable
  FROM events
),
pages_seen AS (
  SELECT feed_id, run_id, min(ts) AS started_at,
         CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 7 THEN 'error'
              WHEN count(*) FILTER (WHERE event_type = 'view') = 0 THEN 'not_modified'
              ELSE 'ok' END AS status
  FROM entries GROUP BY feed_id, run_id
),
stored AS (
  SELECT e.* FROM entries e JOIN pages_seen p USING (feed_id, run_id) WHERE p.status = 'ok'
),
first_seen AS (
  SELECT url, arg_min(feed_id, seq) AS feed_id, arg_min(run_id, seq) AS run_id,
         arg_min(published_at, seq) AS frozen_at, arg_min(reliable, seq) AS frozen_reliable
  FROM stored GROUP BY url
),
facts AS (
  SELECT feed_id, run_id, count(*) AS n_entries, count(DISTINCT url) AS n_seen,
         count(*) FILTER (WHERE reliable) AS n_reliable,
         min(published_at) FILTER (WHERE reliable) AS oldest,
         max(published_at) FILTER (WHERE reliable) AS newest
  FROM stored GROUP BY feed_id, run_id
),
run_new AS (SELECT feed_id, run_id, count(*) AS n_new FROM first_seen GROUP BY feed_id, run_id),
run_max AS (
  SELECT s.feed_id, s.run_id, max(f.frozen_at) FILTER (WHERE f.frozen_reliable) AS top
  FROM stored s JOIN first_seen f USING (url) GROUP BY s.feed_id, s.run_id
),
joined AS (
  SELECT p.feed_id, p.run_id, p.status, coalesce(n.n_new, 0) AS n_new, coalesce(a.n_seen, 0) AS n_seen,
         coalesce(a.n_entries, 0) AS n_entries, coalesce(a.n_reliable, 0) AS n_reliable, a.oldest, a.newest,
         max(m.top) OVER (PARTITION BY p.feed_id ORDER BY p.started_at
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
  FROM pages_seen p LEFT JOIN facts a USING (feed_id, run_id)
  LEFT JOIN run_new n USING (feed_id, run_id) LEFT JOIN run_max m USING (feed_id, run_id)
),
judged AS (
  SELECT *, CASE WHEN status <> 'ok' THEN 'not_fetched'
                 WHEN n_entries = 0 THEN 'empty_page'
                 WHEN n_reliable < 3 OR n_reliable < 0.5 * n_entries THEN 'few_reliable_dates'
                 WHEN n_reliable >= 5 AND newest - oldest < INTERVAL 5 MINUTE THEN 'no_chronology'
                 WHEN prev_max IS NULL THEN 'first_run'
                 WHEN oldest <= prev_max THEN 'overlap'
                 WHEN n_new = 0 THEN 'dates_moved'
                 ELSE 'overlap_lost' END AS gap_reason
  FROM joined
)"""

_WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"


def _clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_WS}', ' ', 'g'))"


_TEN_MINUTES = """
paged AS (
  SELECT event_id, epoch_us(ts) // 600000000 AS page_id, ts AS published_at, event_type <> 'error' AS reliable
  FROM events
),
facts AS (
  SELECT page_id, count(*) AS n_entries, count(*) FILTER (WHERE reliable) AS n_reliable,
         min(published_at) FILTER (WHERE reliable) AS oldest, max(published_at) FILTER (WHERE reliable) AS newest,
         count(*) FILTER (WHERE reliable) >= 5
           AND max(published_at) FILTER (WHERE reliable) - min(published_at) FILTER (WHERE reliable)
               < INTERVAL 5 MINUTE AS degenerate
  FROM paged GROUP BY page_id
)"""

# Tracking parameters.
_TRACKING = """['fbclid', 'gclid', 'gbraid', 'wbraid', 'dclid', 'msclkid', 'yclid', 'igshid', 'mc_cid', 'mc_eid',
  '_hsenc', '_hsmi', 'vero_id', 'oly_enc_id', 'ck_subscriber_id', 'ref', 'source', 'cmpid', 'ncid', 'spm',
  'at_medium', 'at_campaign', 'amp', 'outputtype']"""

_CANONICAL = f"""
cut AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query
  FROM pages
),
parts AS (
  SELECT page_id,
         CASE WHEN length(host) - length(replace(host, '.', '')) >= 2
              THEN regexp_replace(lower(host), '^(m|amp)\\.', '') ELSE lower(host) END AS host,
         array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') AS path,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
           AND NOT list_contains({_TRACKING}, lower(string_split(x, '=')[1]))
           AND NOT regexp_matches(lower(x), '^(utm_|pk_|piwik_|_ga|at_custom)'))), '&') AS query
  FROM cut
),
canonical AS (
  SELECT page_id, 'https://' || host || CASE WHEN path = '' THEN '' ELSE '/' || path END
                  || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_canonical
  FROM parts
)"""

_SYNC = """
shared AS (
  SELECT 'supplier-' || s_suppkey AS slug, s_name AS name, s_acctbal AS balance, n_name,
         CASE WHEN n_regionkey < 3 THEN 'fr' ELSE 'en' END AS lang
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
stored AS (SELECT slug, name, lang, balance < 9000 AS is_active FROM shared WHERE balance > 500),
declared AS (
  SELECT slug, CASE WHEN balance BETWEEN 3000 AND 5000 THEN name || ' ' || n_name ELSE name END AS name, lang
  FROM shared WHERE balance < 9500
),
actions AS (
  SELECT coalesce(s.slug, d.slug) AS slug,
         CASE WHEN s.slug IS NULL THEN 'created'
              WHEN d.slug IS NULL THEN CASE WHEN s.is_active THEN 'deactivated' ELSE 'absent' END
              WHEN s.name <> d.name OR s.lang <> d.lang OR NOT s.is_active THEN 'updated'
              ELSE 'unchanged' END AS action,
         s.name AS old_name, d.name AS new_name, coalesce(d.lang, s.lang) AS lang, s.is_active
  FROM stored s FULL JOIN declared d ON s.slug = d.slug
)"""

_ATTEMPT_LINES = """
parsed AS (
  SELECT CASE event_type WHEN 'signup' THEN date_trunc('second', ts)
              WHEN 'view' THEN date_trunc('second', ts) - INTERVAL 2 HOUR
              WHEN 'purchase' THEN date_trunc('hour', ts) END AS attempted_at,
         CASE event_type WHEN 'signup' THEN 'docker_unavailable' WHEN 'view' THEN 'wrapper_error'
              WHEN 'purchase' THEN 'lock_held' END AS reason,
         CASE event_type WHEN 'signup' THEN 'k ' || json_extract_string(props, '$.k')
              WHEN 'purchase' THEN nullif(json_extract_string(props, '$.k'), '0') END AS detail
  FROM events WHERE event_type IN ('signup', 'view', 'purchase')
)"""

_DOC_PAGES = """
shown AS (
  SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS feed_id, doc_id, lang, text,
         unnest(CASE WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 2 = 0
                     THEN [doc_id // 200, doc_id // 200 + 1] ELSE [doc_id // 200] END) AS run_id
  FROM documents
)"""


def _fingerprint(table: str, columns: dict[str, str]) -> str:
    texts = ", ".join(
        f"coalesce({'CAST(epoch_us(' + c + ') AS VARCHAR)' if kind == 'ts' else 'CAST(' + c + ' AS VARCHAR)'}, chr(0))"
        for c, kind in sorted(columns.items())
    )
    return f"""SELECT '{table}' AS table_name, count(*) AS n_rows,
  CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {texts})), 1, 15) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM {table}"""


def _columns(*names: str, **kinds: str) -> dict[str, str]:
    return {**dict.fromkeys(names, ""), **kinds}


_TABLE_COLUMNS = {
    "region": _columns("r_regionkey", "r_name"),
    "nation": _columns("n_nationkey", "n_name", "n_regionkey"),
    "customer": _columns("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": _columns("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": _columns("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": _columns(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", o_orderdate="ts"
    ),
    "lineitem": _columns(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        l_shipdate="ts",
    ),
    "events": _columns("event_id", "user_id", "event_type", "value", "props", ts="ts"),
    "documents": _columns("doc_id", "text", "lang", "source", "n_chars"),
    "pages": _columns("page_id", "url", "html"),
    "benchmark": _columns("item_id", "text"),
    "labels": _columns("doc_id", "quality", "toxic"),
    "conversations": _columns("conv_id", "turn", "role", "text"),
}

# --- the statements ---------------------------------------------------------------------

# Three attempts a run; ten feeds take turns, and every seventh run is of a feed without number.
_ATTEMPTS = """attempts AS (
  SELECT CASE WHEN (event_id // 3) % 7 = 6 THEN -1 ELSE (event_id // 3) % 10 END AS feed_id, event_id // 3 AS run_id,
         event_id % 3 + 1 AS attempt, event_type, ts,
         CASE WHEN event_type = 'click' AND value < 10 THEN NULL WHEN event_type = 'view' THEN 304
              WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS code,
         event_type = 'error' AND value < 20 AS lost
  FROM events
)"""


ORACLES: dict[str, str] = {
    "coverage_gaps": f"""WITH {_INTERVALS}
SELECT feed_id, epoch_us(start_at) AS start_us, epoch_us(end_at) AS end_us, ongoing, missed_attempts,
       length_us AS duration_us
FROM counted""",
    "feed_coverage": f"""WITH {_INTERVALS}
SELECT feed_id, slug, n_runs, epoch_us(first_run) AS first_run_us, epoch_us(last_run) AS last_run_us,
       median_interval_us, worst_interval_us, n_gaps, has_ongoing_gap, observed, n_suspected
FROM feed_rows""",
    "coverage_summary": f"""WITH {_INTERVALS}
SELECT epoch_us(min(first_run)) AS window_start_us, count(*) AS n_feeds,
       count(*) FILTER (WHERE has_ongoing_gap) AS n_feeds_with_ongoing_gap,
       (SELECT count(*) FROM attempts) AS missed_total
FROM feed_rows""",
    "coverage_table": f"""WITH {_INTERVALS}
SELECT slug, is_active, n_runs, coalesce({_absolute('first_run')}, 'jamais') AS first_run,
       CASE WHEN last_run IS NULL THEN 'jamais'
            ELSE {_relative(f'epoch_us({_NOW}) - epoch_us(last_run)', 'last_run')} END AS last_run,
       CASE WHEN observed THEN {_duration('CAST(floor(median_interval_us) AS BIGINT)')} ELSE '—' END AS median_interval,
       {_duration('worst_interval_us')} AS worst_interval, n_gaps, n_suspected, has_ongoing_gap
FROM feed_rows""",
    "gap_table": f"""WITH {_INTERVALS}
SELECT slug, is_active, epoch_us(start_at) AS start_us, {_attribute('start_at')} AS start_attr,
       {_absolute('start_at')} AS since,
       CASE WHEN ongoing THEN 'en cours' ELSE {_absolute('end_at')} END AS until,
       {_duration('length_us')} AS duration,
       CASE WHEN missed_attempts > 0 THEN CAST(missed_attempts AS VARCHAR) ELSE '—' END AS missed_attempts
FROM counted JOIN feeds USING (feed_id)""",
    "feed_health": f"""WITH {_HEALTH}
SELECT feed_id, slug, epoch_us(started_at) AS started_at_us, status, http_status, n_articles,
       CASE WHEN status = 'error' THEN {_KIND} ELSE '' END AS error_kind, gap_status
FROM health""",
    "health_table": f"""WITH {_HEALTH}
SELECT slug, 'Feed ' || feed_id AS name, is_active, {_LANG} AS lang, {_TOPIC} AS topic, {_SOURCE} AS source_type,
       CASE WHEN started_at IS NULL THEN 'jamais'
            ELSE {_relative(f'epoch_us({_NOW}) - epoch_us(started_at)', 'started_at')} END AS last_run,
       coalesce(status, '—') AS status,
       CASE WHEN status = 'error' THEN {_KIND_LABEL} ELSE '' END AS error_kind_label,
       CASE WHEN started_at IS NULL THEN '—' ELSE {_GAP} END AS coverage,
       coalesce(CAST(http_status AS VARCHAR), '—') AS http_status, coalesce(CAST(n_new AS VARCHAR), '—') AS n_new,
       coalesce(CAST(k AS VARCHAR), '—') AS n_seen, n_articles, coalesce(error_message, '') AS message
FROM health""",
    "article_listing": f"""WITH {_ARTICLES}
SELECT url_canonical, title, slug, lang, topic, epoch_us(published_at) AS published_at_us, first_seq
FROM articles JOIN doc_feeds ON first_feed_id = feed_id
WHERE lang = 'fr' AND topic IN ('ai', 'both')
ORDER BY published_at DESC, first_seq DESC LIMIT 50 OFFSET 50""",
    "listing_table": f"""WITH {_ARTICLES},
page AS (
  SELECT *, {_clean('summary_clean')} AS plain FROM articles JOIN doc_feeds ON first_feed_id = feed_id
  ORDER BY published_at DESC, first_seq DESC LIMIT 50
)
SELECT url_canonical, title, name AS source, {_attribute('published_at')} AS published_attr,
       {_absolute('published_at')} AS published_absolute,
       {_relative(f'epoch_us({_NOW}) - epoch_us(published_at)', 'published_at')} AS published_relative,
       date_source = 'fetched' AS is_fallback, {_LANG} AS lang, {_TOPIC} AS topic,
       CASE WHEN length(plain) <= 240 THEN plain
            ELSE regexp_replace(substr(plain, 1, 240), ' [^ ]*$', '') || '…' END AS summary
FROM page""",
    "listing_page_info": f"""WITH {_ARTICLES}
SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages,
       true AS has_previous, 2 < greatest(1, ceil(count(*) / 50.0)) AS has_next
FROM articles JOIN doc_feeds ON first_feed_id = feed_id WHERE topic IN ('sec', 'both')""",
    "newest_article": f"""WITH {_ARTICLES}
SELECT epoch_us(max(published_at)) AS latest_published_at_us FROM articles""",
    "article_flags": f"""WITH {_FOLD}
SELECT date_source = 'fetched' AS is_fallback, updated_at > first_seen_at AS was_revised, count(*) AS n_articles
FROM article GROUP BY ALL""",
    "run_summary": f"""WITH {_RUNS}
SELECT count(*) AS n_runs, count(*) FILTER (WHERE status <> 'error') AS n_ok,
       CAST(coalesce(sum(n_new), 0) AS BIGINT) AS n_new,
       CASE WHEN count(*) = 0 THEN 2 WHEN count(*) FILTER (WHERE status <> 'error') = 0 THEN 1 ELSE 0 END AS verdict
FROM runs""",
    "label_counts": f"""WITH {_RUNS}
SELECT {_KIND} AS error_kind, {_KIND_LABEL} AS error_kind_label, {_GAP} AS gap_label, {_LANG} AS lang_label,
       {_TOPIC} AS topic_label, {_SOURCE} AS source_label, count(*) AS n_runs
FROM runs JOIN feeds USING (feed_id) GROUP BY ALL""",
    "article_fold": _ARTICLE_ROWS,
    "stream_upsert": _ARTICLE_ROWS,
    "observation_fold": f"""WITH {_OBS}
SELECT url_canonical, feed_id, arg_max(struct_pack(g := guid), seq).g AS guid,
       arg_max(url_original, seq) AS url_original, epoch_us(arg_min(seen_at, seq)) AS first_seen_at_us,
       epoch_us(arg_max(seen_at, seq)) AS last_seen_at_us
FROM obs GROUP BY url_canonical, feed_id""",
    "run_new_seen": f"""WITH {_OBS},
firsts AS (
  SELECT arg_min(feed_id, seq) AS feed_id, arg_min(run_id, seq) AS run_id FROM obs GROUP BY url_canonical
),
fresh AS (SELECT feed_id, run_id, count(*) AS n_new FROM firsts GROUP BY feed_id, run_id)
SELECT feed_id, run_id, count(DISTINCT url_canonical) AS n_seen, coalesce(any_value(n_new), 0) AS n_new,
       count(*) - count(DISTINCT url_canonical) AS n_duplicates
FROM obs LEFT JOIN fresh USING (feed_id, run_id) GROUP BY feed_id, run_id""",
    "prev_max_by_run": f"""WITH {_OBS},
frozen AS (
  SELECT url_canonical, arg_min(published_at, seq) AS published_at, arg_min(date_source, seq) AS date_source
  FROM obs GROUP BY url_canonical
),
run_max AS (
  SELECT o.feed_id, o.run_id, max(f.published_at) FILTER (WHERE f.date_source <> 'fetched') AS top
  FROM obs o JOIN frozen f USING (url_canonical) GROUP BY o.feed_id, o.run_id
)
SELECT feed_id, run_id,
       epoch_us(max(top) OVER (PARTITION BY feed_id ORDER BY run_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prev_max_published_us
FROM run_max""",
    "feed_maxima": f"""WITH {_FOLD}
SELECT k.feed_id, epoch_us(max(a.published_at)) AS max_published_us
FROM kept k JOIN article a USING (url_canonical) WHERE a.date_source <> 'fetched' GROUP BY k.feed_id""",
    "gap_verdicts": f"""WITH {_ENTRIES}
SELECT feed_id, run_id, status, n_new, n_seen,
       CASE gap_reason WHEN 'overlap' THEN 'none' WHEN 'overlap_lost' THEN 'suspected' ELSE 'unknown' END AS gap_status,
       gap_reason,
       CASE WHEN gap_reason IN ('first_run', 'overlap', 'dates_moved', 'overlap_lost') THEN epoch_us(oldest) END
         AS oldest_in_page_us,
       CASE WHEN status = 'ok' THEN epoch_us(prev_max) END AS prev_max_published_us
FROM judged""",
    "degenerate_pages": f"""WITH {_TEN_MINUTES}
SELECT page_id, n_entries, n_reliable, epoch_us(oldest) AS oldest_reliable_us, epoch_us(newest) AS newest_reliable_us,
       coalesce(degenerate, false) AS degenerate
FROM facts""",
    "demoted_dates": f"""WITH {_TEN_MINUTES}
SELECT event_id, CASE WHEN reliable AND NOT coalesce(degenerate, false) THEN 'published' ELSE 'fetched' END AS date_source,
       CASE WHEN reliable AND coalesce(degenerate, false) THEN (page_id + 1) * 600000000
            ELSE epoch_us(published_at) END AS published_at_us
FROM paged JOIN facts USING (page_id)""",
    "canonical_urls": f"""WITH {_CANONICAL}
SELECT page_id, url_canonical, CAST(NULL AS VARCHAR) AS reject_reason FROM canonical""",
    "canonical_variants": f"""WITH {_CANONICAL}, forms AS (
  SELECT page_id % 13 AS form, p.* FROM parts p
)
SELECT page_id,
  CASE WHEN form NOT IN (7, 10, 11, 12) THEN 'https://'
    || CASE form WHEN 8 THEN 'xn--bcher-kva.' || lower((SELECT host FROM cut WHERE cut.page_id = forms.page_id)) ELSE host END
    || CASE form WHEN 2 THEN ':8080' WHEN 9 THEN '/~z%2Fz' ELSE '' END
    || CASE WHEN path = '' THEN '' ELSE '/' || path END
    || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_canonical,
  CASE form WHEN 7 THEN 'scheme' WHEN 10 THEN 'port' WHEN 11 THEN 'missing' WHEN 12 THEN 'host' END AS reject_reason
FROM forms""",
    "embedding_fingerprint": """
SELECT 'embeddings' AS table_name, count(*) AS n_rows,
  CAST(sum(CAST(('0x' || substr(md5(
    array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ',')
    || chr(31) || label || chr(31) || vec_id), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM embeddings""",
    "canonical_duplicates": f"""WITH {_CANONICAL}
SELECT url_canonical, count(*) AS n_pages, min(page_id) AS first_page_id FROM canonical GROUP BY url_canonical""",
    "content_hashes": f"""
SELECT doc_id, sha256('Document ' || doc_id || chr(31) || {_clean('text')}) AS content_hash FROM documents""",
    "duplicate_texts": f"""
SELECT sha256(chr(31) || {_clean('text')}) AS content_hash, count(*) AS n_copies, min(doc_id) AS first_doc_id
FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "double_escapes": "SELECT page_id, md5("
    + "regexp_replace(" * 3
    + "html"
    + ", '&amp;(#[0-9]{1,7};|#[xX][0-9a-fA-F]{1,6};|[a-zA-Z][a-zA-Z0-9]{1,31};)', '&\\1', 'g')" * 3
    + ") AS fixed_md5 FROM pages",
    "strip_tags_native": f"""
SELECT page_id, {_clean('''regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<(?:script|style)\\b[^>]*>.*?</(?:script|style)\\s*>', '', 'g'),
  '(?s)<!--.*?-->', '', 'g'), '(?s)</?[a-zA-Z!?][^>]*>', '', 'g')''')} AS text
FROM pages""",
    "clean_titles": f"""
SELECT page_id, {_clean("""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
  '&quot;?', '"', 'g'), '&#(?:39|x27);?', '''', 'g'), '&amp;?', '&', 'g')""")} AS title
FROM pages""",
    "excerpts": f"""
SELECT doc_id, CASE WHEN length(t) <= 240 THEN t
                    ELSE regexp_replace(substr(t, 1, 240), ' [^ ]*$', '') || '…' END AS excerpt
FROM (SELECT doc_id, {_clean('text')} AS t FROM documents)""",
    "dates_resolved": """
WITH read AS (
  SELECT event_id, ts + INTERVAL 1 HOUR AS fetched_at,
         CASE event_id % 11
           WHEN 0 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
           WHEN 1 THEN date_trunc('minute', ts) + INTERVAL 5 HOUR
           WHEN 2 THEN ts + INTERVAL 450 MINUTE
           WHEN 3 THEN date_trunc('second', ts)
           WHEN 4 THEN date_trunc('second', ts)
           WHEN 5 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
           WHEN 6 THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
           WHEN 8 THEN TIMESTAMP '1970-01-01 00:00:00'
           WHEN 9 THEN TIMESTAMP '2129-08-19 08:30:00' END AS published,
         CASE WHEN event_type = 'view' THEN date_trunc('second', ts) END AS updated
  FROM events
),
judged AS (
  SELECT *, coalesce(published BETWEEN TIMESTAMP '2000-01-01' AND fetched_at + INTERVAL 2 HOUR, false) AS p,
         coalesce(updated BETWEEN TIMESTAMP '2000-01-01' AND fetched_at + INTERVAL 2 HOUR, false) AS u
  FROM read
)
SELECT event_id, epoch_us(CASE WHEN p THEN published WHEN u THEN updated ELSE fetched_at END) AS published_us,
       CASE WHEN p THEN 'published' WHEN u THEN 'updated' ELSE 'fetched' END AS date_source
FROM judged""",
    "report_times": f"""
WITH aged AS (
  SELECT event_id, ts, (epoch_us({_NOW}) - epoch_us(ts)) // (event_id % 997 + 1) AS age FROM events
)
SELECT event_id, {_absolute('ts')} AS absolute, {_attribute('ts')} AS attribute,
       {_relative('age', f'({_NOW} - to_microseconds(age))')} AS relative, {_duration('age')} AS duration
FROM aged""",
    "declaration_sync": f"WITH {_SYNC} SELECT slug, action FROM actions",
    "sync_report": f"""WITH {_SYNC}
SELECT name AS action, (SELECT count(*) FROM actions WHERE action = name) AS n_feeds
FROM (VALUES ('created'), ('updated'), ('unchanged'), ('deactivated')) AS a(name)""",
    "synced_feeds": f"""WITH {_SYNC}
SELECT slug, CASE WHEN action IN ('created', 'updated') THEN new_name ELSE old_name END AS name, lang,
       CASE WHEN action IN ('created', 'updated') THEN true WHEN action = 'deactivated' THEN false
            ELSE is_active END AS is_active,
       CASE WHEN action IN ('created', 'updated', 'deactivated') THEN epoch_us({_NOW}) END AS updated_at_us
FROM actions""",
    "declaration_audit": """
WITH d AS (
  SELECT lower(replace(c_name, '#', '-')) AS id,
         CASE WHEN c_acctbal < 0 THEN 'ftp' ELSE 'https' END || '://nation-' || c_nationkey || '.example/'
           || CAST(floor(c_acctbal) AS BIGINT) AS url,
         c_acctbal, c_nationkey, c_mktsegment
  FROM customer
)
SELECT id, 'url_scheme' AS rule FROM d WHERE c_acctbal < 0
UNION ALL SELECT id, 'lang' FROM d WHERE c_nationkey >= 20
UNION ALL SELECT id, 'topic' FROM d WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT min(id), 'duplicate_url' FROM d GROUP BY url HAVING count(*) > 1""",
    "attempt_log": f"""WITH {_ATTEMPT_LINES}
SELECT epoch_us(attempted_at) AS attempted_at_us, reason, arg_min(struct_pack(d := detail), struct_pack(n := detail IS NULL, d := detail)).d AS detail
FROM parsed p
WHERE NOT (attempted_at < TIMESTAMP '2024-01-05' AND reason = 'docker_unavailable')
GROUP BY attempted_at, reason""",
    "stream_attempts": f"""WITH {_ATTEMPT_LINES}
SELECT DISTINCT epoch_us(attempted_at) AS attempted_at_us, reason FROM parsed""",
    "constraint_audit": """
WITH f AS (SELECT DISTINCT source, lang FROM documents),
r AS (
  SELECT user_id, event_type,
         'u-' || user_id || '|' || regexp_replace(CAST(ts AS VARCHAR), '(\\.[0-9]*?)0*$', CASE WHEN ts = date_trunc('second', ts) THEN '' ELSE '\\1' END) AS key
  FROM events WHERE event_type <> 'signup'
),
m AS (
  SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour_at, value >= 50 AS drained,
         CASE WHEN value < 10 THEN 'unheard' WHEN value < 90 THEN 'lock_held' END AS reason
  FROM events WHERE event_type = 'signup'
),
a AS (
  SELECT sha256(text) AS url, CASE WHEN n_chars < 20000 THEN 's-' || source ELSE 's-none' END AS feed_id,
         n_chars, lang, text
  FROM documents
),
broken AS (
  SELECT 'feed' AS table_name, 'not_null:name' AS rule, source AS row_key, 1 AS n FROM f WHERE lang = 'es'
  UNION ALL SELECT 'feed', 'domain:lang', source, 1 FROM f WHERE lang NOT IN ('fr', 'en')
  UNION ALL SELECT 'feed', 'unique:slug', source, count(*) FROM f GROUP BY source HAVING count(*) > 1
  UNION ALL SELECT 'article', 'not_null:title', url, 1 FROM a WHERE n_chars <= 100
  UNION ALL SELECT 'article', 'domain:date_source', url, 1 FROM a WHERE lang = 'fr'
  UNION ALL SELECT 'article', 'exact_length:content_hash', url, 1 FROM a WHERE n_chars > 15000
  UNION ALL SELECT 'article', 'unique:url_canonical', url, count(*) FROM a GROUP BY url HAVING count(*) > 1
  UNION ALL SELECT 'article', 'reference:first_feed_id', feed_id, count(*) FROM a
            WHERE feed_id = 's-none' GROUP BY feed_id
  UNION ALL SELECT 'article', 'not_null:first_feed_id', 'https://part.example/' || p_partkey, 1 FROM part
            WHERE p_partkey % 10 <> 0
  UNION ALL SELECT 'article_feed', 'not_null:url_original', 'https://part.example/' || l_partkey || '|p-' || l_suppkey, 1
            FROM lineitem WHERE l_linenumber >= 7
  UNION ALL SELECT 'article_feed', 'not_null:last_seen_at', 'https://part.example/' || l_partkey || '|p-' || l_suppkey, 1
            FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'article_feed', 'unique:url_canonical,feed_id', 'https://part.example/' || l_partkey || '|p-' || l_suppkey,
            count(*) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
  UNION ALL SELECT 'article_feed', 'reference:url_canonical', 'https://part.example/' || l_partkey, count(*)
            FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0) GROUP BY l_partkey
  UNION ALL SELECT 'article_feed', 'reference:feed_id', 'p-' || l_suppkey, count(*)
            FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY l_suppkey
  UNION ALL SELECT 'feed_run', 'domain:status', key, 1 FROM r WHERE event_type = 'view'
  UNION ALL SELECT 'feed_run', 'domain:gap_status', key, 1 FROM r WHERE event_type = 'purchase'
  UNION ALL SELECT 'feed_run', 'not_null:n_new', key, 1 FROM r WHERE event_type = 'error'
  UNION ALL SELECT 'feed_run', 'reference:feed_id', 'u-' || user_id, count(*) FROM r WHERE user_id % 5 = 0 GROUP BY user_id
  UNION ALL SELECT 'missed_run', 'not_null:reason', hour_at || '|', 1 FROM m WHERE reason IS NULL
  UNION ALL SELECT 'missed_run', 'not_null:drained_at', hour_at || '|' || coalesce(reason, ''), 1 FROM m WHERE NOT drained
  UNION ALL SELECT 'missed_run', 'domain:reason', hour_at || '|' || reason, 1 FROM m WHERE reason = 'unheard'
  UNION ALL SELECT 'missed_run', 'unique:attempted_at,reason', hour_at || '|' || reason, count(*) FROM m
            WHERE reason IS NOT NULL GROUP BY hour_at, reason HAVING count(*) > 1
)
SELECT table_name, rule, row_key, CAST(sum(n) AS BIGINT) AS n_rows FROM broken GROUP BY ALL""",
    "table_fingerprint": "\nUNION ALL ".join(_fingerprint(t, c) for t, c in _TABLE_COLUMNS.items()),
    "purge_preview": f"""WITH {_FOLD},
deleted AS (SELECT s_suppkey AS feed_id FROM supplier WHERE s_acctbal < 0),
doomed AS (SELECT url_canonical FROM article WHERE first_feed_id IN (SELECT feed_id FROM deleted))
SELECT 'feeds' AS table_name, count(*) AS n_rows FROM supplier
  WHERE s_suppkey NOT IN (SELECT feed_id FROM deleted)
UNION ALL SELECT 'runs', count(*) FROM (SELECT DISTINCT feed_id, run_id FROM obs)
  WHERE feed_id NOT IN (SELECT feed_id FROM deleted)
UNION ALL SELECT 'articles', count(*) FROM article WHERE url_canonical NOT IN (SELECT url_canonical FROM doomed)
UNION ALL SELECT 'sightings', count(*) FROM (SELECT DISTINCT url_canonical, feed_id FROM obs)
  WHERE feed_id NOT IN (SELECT feed_id FROM deleted)
    AND url_canonical NOT IN (SELECT url_canonical FROM doomed)""",
    "page_entries": f"""WITH {_DOC_PAGES}
SELECT feed_id, run_id,
       CAST(row_number() OVER (PARTITION BY feed_id, run_id ORDER BY doc_id) - 1 AS INTEGER) AS entry_pos,
       'https://docs.example.com/' || lang || '/' || doc_id || '?id=' || doc_id AS url_canonical,
       'doc:' || doc_id AS guid, 'Document ' || doc_id AS title,
       sha256('Document ' || doc_id || chr(31) || {_clean('text')}) AS content_hash,
       epoch_us(TIMESTAMP '2024-01-01 00:00:00') + doc_id * 3600000000 AS published_at_us,
       'published' AS date_source
FROM shown""",
    "ingest_documents": f"""WITH {_DOC_PAGES},
page AS (
  SELECT feed_id, run_id, count(*) AS n_seen, count(*) FILTER (WHERE doc_id // 200 = run_id) AS n_new,
         min(doc_id) AS oldest, max(doc_id) AS newest
  FROM shown GROUP BY feed_id, run_id
),
ordered AS (
  SELECT *, max(newest) OVER (PARTITION BY feed_id ORDER BY run_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM page
),
judged AS (
  SELECT *, CASE WHEN n_seen < 3 THEN 'few_reliable_dates' WHEN known IS NULL THEN 'first_run'
                 WHEN oldest <= known THEN 'overlap' WHEN n_new = 0 THEN 'dates_moved'
                 ELSE 'overlap_lost' END AS gap_reason
  FROM ordered
)
SELECT feed_id, run_id, 'ok' AS status, n_new, n_seen,
       CASE gap_reason WHEN 'overlap' THEN 'none' WHEN 'overlap_lost' THEN 'suspected' ELSE 'unknown' END AS gap_status,
       gap_reason,
       CASE WHEN gap_reason <> 'few_reliable_dates'
            THEN epoch_us(TIMESTAMP '2024-01-01 00:00:00') + oldest * 3600000000 END AS oldest_in_page_us,
       epoch_us(TIMESTAMP '2024-01-01 00:00:00') + known * 3600000000 AS prev_max_published_us
FROM judged
UNION ALL
SELECT feed_id, -run_id - 1, CASE WHEN run_id % 2 = 0 THEN 'not_modified' ELSE 'error' END, 0, 0, 'unknown',
       'not_fetched', NULL, NULL
FROM page WHERE (feed_id + run_id) % 3 = 0""",
    "run_outcomes": f"""WITH {_ATTEMPTS},
decided AS (
  SELECT *, row_number() OVER (
    PARTITION BY run_id
    ORDER BY CASE WHEN event_type <> 'error' THEN attempt ELSE 4 END, attempt DESC) AS nth
  FROM attempts
)
SELECT feed_id, run_id, attempt, CASE WHEN NOT lost THEN code END AS http_status,
       CASE WHEN lost OR code IS NULL OR code IN (404, 503) OR event_type = 'purchase' THEN 'error'
            WHEN code = 304 THEN 'not_modified' ELSE 'ok' END AS status,
       'FetchError: feed-' || feed_id || ' : ' ||
         CASE WHEN lost THEN 'timed out' WHEN code IS NULL THEN 'reponse sans statut'
              WHEN code IN (404, 503) THEN 'HTTP ' || code
              WHEN event_type = 'purchase' THEN 'HTTP 200 sans contenu' END AS error_message
FROM decided WHERE nth = 1 AND feed_id IN (SELECT user_id FROM events)""",
    "unknown_feed_runs": f"""WITH {_ATTEMPTS}
SELECT feed_id, run_id, count(*) AS n_attempts, epoch_us(min(ts)) AS started_at_us FROM attempts
WHERE feed_id NOT IN (SELECT user_id FROM events) GROUP BY feed_id, run_id""",
    "page_encodings": """
WITH d AS (SELECT doc_id, '€ œ ’ ' || coalesce(text, '') AS t,
  CASE WHEN regexp_matches(coalesce(text, ''), '[^\\x{0}-\\x{7F}\\x{A0}-\\x{A3}\\x{A7}\\x{A9}-\\x{B3}\\x{B5}-\\x{B7}\\x{BF}-\\x{FF}]') THEN 0
       ELSE doc_id % 5 END AS form FROM documents)
SELECT doc_id,
  md5(CASE WHEN form = 2 THEN replace(replace(replace(t, '€', '?'), 'œ', '?'), '’', '?')
           WHEN form = 4 THEN replace(t, '’', '?') ELSE t END) AS text_md5,
  CASE WHEN form = 1 THEN 'encodage autre que celui declare' END AS warning
FROM d""",
    "article_listing_deep": f"""WITH {_ARTICLES}, chosen AS (SELECT * FROM articles JOIN doc_feeds ON first_feed_id = feed_id)
SELECT url_canonical, title, slug, lang, topic, epoch_us(published_at) AS published_at_us, first_seq
FROM chosen ORDER BY published_at DESC NULLS LAST, first_seq DESC
LIMIT 50 OFFSET (SELECT greatest(0, (count(*) - 1) // 50 * 50) FROM chosen)""",
    "validators": """
SELECT feed_id, v.etag AS etag, v.last_modified AS last_modified FROM (
  SELECT user_id AS feed_id,
         arg_max(struct_pack(etag := CASE WHEN event_type = 'click' THEN props END,
                             last_modified := CASE WHEN value < 50 THEN CAST(value AS VARCHAR) END),
                 struct_pack(ts := ts, id := event_id)) AS v
  FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id)""",
}

ORACLES["stream_feed_state"] = ORACLES["prev_max_by_run"]
ORACLES["resolved_links"] = """
WITH cut AS (
  SELECT page_id, url, regexp_extract(url, '^(https?:)', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root,
         regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), d AS (
  SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS dir FROM cut
), p AS (
  SELECT *, CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]+/$', '') END AS parent FROM d
)
SELECT page_id, CASE page_id % 11
  WHEN 0 THEN 'https://o.example/a?b#c' WHEN 1 THEN root || dir || 'z/1.html' WHEN 2 THEN root || '/z/2?x=1'
  WHEN 3 THEN root || parent || 'z3' WHEN 4 THEN root || dir || 'z4' WHEN 5 THEN root || path || '?q=5'
  WHEN 6 THEN regexp_replace(url, '#.*$', '') || '#f6' WHEN 7 THEN scheme || '//o.example/x/y'
  WHEN 8 THEN root || '/z8' WHEN 9 THEN root || parent ELSE root || dir || 'c/' END AS resolved
FROM p"""
ORACLES["sql_functions"] = f"""
SELECT c.page_id, c.url_canonical, c.reject_reason, x.excerpt, r.absolute, r.attribute, upper(d.lang) AS lang
FROM ({ORACLES["canonical_urls"]}) c JOIN ({ORACLES["excerpts"]}) x ON x.doc_id = c.page_id
JOIN ({ORACLES["report_times"]}) r ON r.event_id = c.page_id JOIN documents d ON d.doc_id = c.page_id"""
ORACLES["page_dialects"] = f"""
WITH d AS (
  SELECT *, doc_id % 6 AS form, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + doc_id * 3600000000 AS at_us,
         sha256('Document ' || doc_id || chr(31) || {_clean("coalesce(text, '')")}) AS content_hash
  FROM documents
), e AS (
  SELECT *, unnest(CASE WHEN form = 5 THEN [0, 1] WHEN form IN (3, 4) THEN [NULL] ELSE [0] END) AS pos FROM d
), links AS (
  SELECT *, CASE form WHEN 0 THEN 'https://atom.example/e/' || doc_id WHEN 1 THEN 'http://rdf.example/n/' || doc_id
                      WHEN 2 THEN 'http://rss.example/a/c/d.html?p=' || doc_id
                      WHEN 5 THEN CASE WHEN pos = 1 THEN 'https://two.example/x/y/' || doc_id END END AS link
  FROM e
)
SELECT doc_id,
       CASE form WHEN 3 THEN 'FeedParseError: racine inconnue, ni RSS ni Atom'
                 WHEN 4 THEN 'FeedParseError: le document n''est pas du XML bien forme' END AS parse_error,
       pos AS entry_pos, link AS url_original, replace(link, 'http://', 'https://') AS url_canonical,
       CASE WHEN pos = 0 AND link IS NULL THEN 'missing' END AS reject_reason,
       CASE WHEN form IN (0, 5) THEN 'atom:' || doc_id END AS guid,
       CASE WHEN pos IS NOT NULL THEN 'Document ' || doc_id END AS title,
       CASE WHEN pos IS NOT NULL THEN content_hash END AS content_hash,
       CASE WHEN pos IS NOT NULL THEN at_us + CASE WHEN form = 2 THEN 86400000000 ELSE 0 END END AS published_at_us,
       CASE WHEN pos IS NOT NULL THEN CASE WHEN form = 2 THEN 'fetched' ELSE 'updated' END END AS date_source
FROM links"""
ORACLES["snapshot_roundtrip"] = f"""
WITH customer_now AS (
  SELECT c_custkey, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'Renamed' ELSE c_name END AS c_name,
         c_nationkey, c_acctbal, c_mktsegment FROM customer
), tables AS (
{" UNION ALL ".join(_fingerprint(n, _TABLE_COLUMNS[n]) for n in ("nation", "orders", "supplier"))}
  UNION ALL {_fingerprint("customer", _TABLE_COLUMNS["customer"]).replace("FROM customer", "FROM customer_now")}
)
SELECT *, 2 AS n_snapshots, 1 AS n_small_copies, 1 AS n_empty_copies, 1 AS n_expired FROM tables"""
# The stream must store what the batch computes.
ORACLES["stream_ingest"] = ORACLES["ingest_documents"]
