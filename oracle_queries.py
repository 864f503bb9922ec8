"""SQL for DuckDB that states independently what each registered query returns."""

from clicktide.schema import CATEGORY_NAMES, HEALTH_LABELS

# Fragments of a WITH clause.
CS = """cs AS (
  SELECT event_id AS id, epoch_us(ts) // 1000 AS timestamp, user_id AS visitorid,
         CASE event_type WHEN 'click' THEN 'addtocart' WHEN 'purchase' THEN 'transaction'
              ELSE event_type END AS event,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS itemid,
         CASE WHEN event_type = 'purchase' THEN event_id END AS transactionid
  FROM events)"""
BUYS = """cs AS (
  SELECT l_orderkey * 8 + l_linenumber AS id, epoch_us(o_orderdate) // 1000 AS timestamp,
         o_custkey AS visitorid, 'transaction' AS event, l_partkey AS itemid,
         l_orderkey AS transactionid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
AS_OF = "newest_time AS (SELECT max(timestamp) AS ms FROM cs)"


def _windows(source="cs", name="ws", extra="TRUE"):
    return f"""{name} AS (
  SELECT make_timestamp(s * 60000000) AS window_start,
         make_timestamp(s * 60000000 + 300000000) AS window_end, event,
         count(*) AS event_count, count(DISTINCT visitorid) AS unique_users,
         count(DISTINCT itemid) AS unique_items
  FROM (SELECT *, unnest(range(timestamp // 60000 - 4, timestamp // 60000 + 1)) AS s FROM {source})
  WHERE {extra}
  GROUP BY s, event)"""


def _totals(source="cs", name="es"):
    return f"""{name} AS (
  SELECT event, count(*) AS total_count, count(DISTINCT visitorid) AS unique_visitors,
         count(DISTINCT itemid) AS unique_items, make_timestamp(max(timestamp) * 1000) AS updated_at
  FROM {source} GROUP BY event)"""


def _with(*parts):
    body, fragments = parts[-1], parts[:-1]
    return "WITH " + ",\n".join(fragments) + "\n" + body


def _percent(part, whole, empty="NULL"):
    # exact decimals, halves up
    share = f"CAST({part} AS DECIMAL(18, 0)) * 100 / CAST(nullif({whole}, 0) AS DECIMAL(18, 0))"
    return f"coalesce(CAST(round(CAST({share} AS DECIMAL(38, 12)), 2) AS DOUBLE), {empty})"


def _since(minutes, column="window_start"):
    return f"{column} >= (SELECT make_timestamp((ms - {minutes} * 60000) * 1000) FROM newest_time)"


def _stages(views="views", carts="addtocarts", purchases="purchases"):
    return ", ".join(
        f"CAST(count(*) FILTER (WHERE event = '{event}') AS BIGINT) AS {name}"
        for event, name in (("view", views), ("addtocart", carts), ("transaction", purchases))
    )


RECENT_HOUR = "recent AS (SELECT cs.* FROM cs, newest_time WHERE timestamp >= ms - 3600000)"
SECOND = "make_timestamp(timestamp // 1000 * 1000000)"
WINDOW_COLUMNS = "window_start, window_end, event, event_count, unique_users, unique_items"


def statistics():
    share = _percent("total_count", "(SELECT sum(total_count) FROM es)")
    raw, windowed, cumulative = HEALTH_LABELS

    def health(label, source, time):
        return (
            f"SELECT '{label}' AS table_name, count(*) AS total_records, max({time}) AS last_event_time, "
            f"((SELECT ms FROM newest_time) * 1000 - epoch_us(max({time}))) / CAST(1000000 AS DOUBLE) "
            f"AS seconds_since_last_event FROM {source}"
        )

    def total_of(event):
        return f"CAST(coalesce(sum(total_count) FILTER (WHERE event = '{event}'), 0) AS BIGINT)"

    return {
        "event_summary": _with(
            CS,
            """SELECT event, count(*) AS event_count, count(DISTINCT visitorid) AS unique_visitors,
                      count(DISTINCT itemid) AS unique_items FROM cs GROUP BY event""",
        ),
        "total_records": "SELECT count(*) AS total_records FROM events",
        "windowed_stats": _with(CS, _windows(), "SELECT * FROM ws"),
        "windowed_stats_sketched": _with(CS, _windows(), "SELECT * FROM ws"),
        "event_statistics": _with(CS, _totals(), "SELECT * FROM es"),
        "approx_distinct_error": _with(
            CS,
            """SELECT event, count(DISTINCT visitorid) AS exact_visitors,
                      count(DISTINCT itemid) AS exact_items, TRUE AS visitors_within_bound,
                      TRUE AS items_within_bound FROM cs GROUP BY event""",
        ),
        "realtime_metrics": _with(CS, AS_OF, _windows(), f"SELECT * FROM ws WHERE {_since(60)}"),
        "latest_activity": _with(CS, AS_OF, _windows(), f"SELECT * FROM ws WHERE {_since(5)}"),
        "recent_event_trend": _with(
            CS, AS_OF, _windows(),
            f"""SELECT event, count(*) AS window_count, CAST(sum(event_count) AS BIGINT) AS total_events,
                       avg(event_count) AS avg_events_per_window,
                       CAST(sum(unique_users) AS BIGINT) AS total_unique_users,
                       avg(unique_users) AS avg_users_per_window
                FROM ws WHERE {_since(30)} GROUP BY event""",
        ),
        "hourly_activity": _with(
            CS, AS_OF, _windows(),
            f"""SELECT date_trunc('hour', window_start) AS hour, event,
                       CAST(sum(event_count) AS BIGINT) AS total_count,
                       CAST(sum(unique_users) AS BIGINT) AS total_users,
                       CAST(sum(unique_items) AS BIGINT) AS total_items
                FROM ws WHERE {_since(1440)} GROUP BY ALL""",
        ),
        "latest_stats": _with(CS, _totals(), "SELECT * FROM es"),
        "views": _with(
            CS,
            """SELECT event, count(*) AS event_count, count(*) AS total_count,
                      count(DISTINCT itemid) AS unique_items FROM cs GROUP BY event""",
        ),
        "event_share": _with(CS, _totals(), f"SELECT *, {share} AS percentage FROM es"),
        "conversion_funnel": _with(
            CS, _totals(),
            f"""funnel AS (SELECT {total_of('view')} AS views, {total_of('addtocart')} AS add_to_carts,
                                  {total_of('transaction')} AS transactions FROM es)""",
            f"""SELECT *, {_percent('add_to_carts', 'views')} AS view_to_cart_rate,
                       {_percent('transactions', 'add_to_carts')} AS cart_to_transaction_rate,
                       {_percent('transactions', 'views')} AS overall_conversion_rate FROM funnel""",
        ),
        "top_items_recent": _with(
            CS, AS_OF, RECENT_HOUR,
            f"""SELECT itemid, count(*) AS total_interactions, {_stages(carts='add_to_carts')}
                FROM recent GROUP BY itemid ORDER BY total_interactions DESC, itemid LIMIT 10""",
        ),
        "active_users": _with(
            CS, AS_OF, RECENT_HOUR,
            f"""SELECT visitorid, count(*) AS action_count, count(DISTINCT event) AS event_types,
                       count(DISTINCT itemid) AS items_viewed, min({SECOND}) AS first_action,
                       max({SECOND}) AS last_action
                FROM recent GROUP BY visitorid ORDER BY action_count DESC, visitorid LIMIT 20""",
        ),
        "event_timeline": _with(
            CS, AS_OF, RECENT_HOUR,
            f"""SELECT date_trunc('minute', {SECOND}) AS minute, event, count(*) AS event_count
                FROM recent GROUP BY ALL ORDER BY minute DESC, event_count DESC, event LIMIT 50""",
        ),
        "pipeline_health": _with(
            CS, AS_OF, _windows(), _totals(),
            " UNION ALL ".join(
                (health(raw, "cs", SECOND), health(windowed, "ws", "window_end"),
                 health(cumulative, "es", "updated_at"))
            ),
        ),
    }


def profile():
    names = ", ".join(f"'{n}'" for n in CATEGORY_NAMES)
    item_stats = f"""SELECT itemid, count(*) AS total_events,
          count(DISTINCT visitorid) AS unique_visitors, {_stages()},
          CAST(count(*) FILTER (WHERE event = 'transaction') AS DOUBLE) / count(*) AS conversion_rate
        FROM cs GROUP BY itemid"""
    return {
        "user_profile": _with(
            CS,
            """SELECT visitorid, count(*) AS total_events,
                      count(*) FILTER (WHERE event = 'addtocart') AS cart_events,
                      count(*) FILTER (WHERE event = 'transaction') AS purchase_events
               FROM cs GROUP BY visitorid""",
        ),
        "user_history": _with(
            CS,
            """SELECT visitorid, CAST(nullif(timestamp, 0) AS VARCHAR) AS timestamp, event, itemid,
                      transactionid, recency
               FROM (SELECT *, row_number() OVER (PARTITION BY visitorid
                                                  ORDER BY timestamp DESC, id DESC) AS recency FROM cs)
               WHERE recency <= 20""",
        ),
        "item_stats": _with(CS, item_stats),
        "purchase_item_stats": _with(BUYS, item_stats),
        "top_products": _with(
            CS,
            f"""SELECT row_number() OVER (ORDER BY total_clicks DESC, item_id) AS rank, *,
                       {_percent('purchases', 'total_clicks', 0)} AS ctr
                FROM (SELECT itemid AS item_id, count(*) AS total_clicks,
                             count(DISTINCT visitorid) AS unique_visitors, {_stages()}
                      FROM cs GROUP BY itemid ORDER BY total_clicks DESC, item_id LIMIT 10)""",
        ),
        "ctr_stats": _with(
            CS,
            f"""SELECT *, {_percent('addtocarts', 'views', 0)} AS view_to_cart_rate,
                       {_percent('purchases', 'addtocarts', 0)} AS cart_to_purchase_rate,
                       {_percent('purchases', 'views', 0)} AS overall_conversion_rate
                FROM (SELECT count(*) AS total_events, {_stages()} FROM cs)""",
        ),
        "hourly_ctr": _with(
            CS,
            f"""SELECT *, {_percent('purchases', 'views', 0)} AS ctr
                FROM (SELECT strftime({SECOND}, '%H') || ':00' AS hour, count(*) AS total_events,
                             {_stages()} FROM cs GROUP BY 1)""",
        ),
        "category_distribution": _with(
            CS,
            """top AS (SELECT itemid, count(*) AS clicks FROM cs GROUP BY itemid
                       ORDER BY clicks DESC, itemid LIMIT 100)""",
            f"""SELECT category, clicks,
                       {_percent('clicks', '(SELECT sum(clicks) FROM top)', 0)} AS percentage
                FROM (SELECT ([{names}])[itemid % 20 + 1] AS category,
                             CAST(sum(clicks) AS BIGINT) AS clicks FROM top GROUP BY 1)""",
        ),
        "popular_items": _with(
            CS,
            """SELECT itemid, count(*) AS clicks FROM cs GROUP BY itemid
               ORDER BY clicks DESC, itemid LIMIT 10""",
        ),
        "dataset_summary": _with(
            CS,
            """SELECT count(*) AS records, count(DISTINCT visitorid) AS users,
                      count(DISTINCT itemid) AS items,
                      CAST(count(*) AS DOUBLE) / count(DISTINCT visitorid) AS avg_events_per_user
               FROM cs""",
        ),
        "event_distribution": _with(CS, "SELECT event, count(*) AS events FROM cs GROUP BY event"),
    }


TWICE = "twice AS (SELECT * FROM cs UNION ALL SELECT * FROM cs WHERE event = 'transaction')"
COPIES = """copies AS (SELECT timestamp, visitorid, event, itemid, count(*) AS cnt
                       FROM twice GROUP BY ALL)"""
KNOWN = "('view', 'addtocart', 'transaction')"


def _classified():
    def says(*words):
        return " OR ".join(f"contains(lower(text), '{w}')" for w in words)

    return f"""messages AS (
      SELECT event_id AS batch_id, props AS raw_data,
        CASE event_type WHEN 'view' THEN 'JSON parse error' WHEN 'click' THEN 'Connection timeout'
             WHEN 'signup' THEN 'read TIMEOUT' WHEN 'purchase' THEN 'duplicate key'
             ELSE 'boom' END || ' at ' || props AS text FROM events
      UNION ALL
      SELECT doc_id, '{{"lang":"' || lang || '","source":"' || source || '"}}', text FROM documents),
    errors AS (
      SELECT *,
        CASE WHEN {says('json', 'parse')} THEN 'json_parse'
             WHEN {says('connect')} THEN 'db_connection'
             WHEN {says('timeout')} THEN 'timeout'
             WHEN {says('constraint', 'duplicate')} THEN 'constraint_violation'
             ELSE 'unknown' END AS error_type FROM messages),
    classified AS (
      SELECT *, CASE error_type WHEN 'json_parse' THEN 'INFO' WHEN 'db_connection' THEN 'CRITICAL'
                  WHEN 'timeout' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM errors)"""


def checks():
    return {
        "duplicate_events": _with(
            CS, TWICE, COPIES,
            """SELECT * FROM copies WHERE cnt > 1
               ORDER BY cnt DESC, timestamp, visitorid, event, itemid LIMIT 10""",
        ),
        "invalid_event_types": _with(
            CS, f"SELECT event, count(*) AS events FROM cs WHERE event NOT IN {KNOWN} GROUP BY event"
        ),
        "validate_schema": """SELECT count(*) AS records, '' AS missing_columns,
                                     '' AS mistyped_columns, TRUE AS passed FROM events""",
        "constraint_violations": _with(
            CS, TWICE, COPIES,
            " UNION ALL ".join(
                f"SELECT 'not_null({c})' AS rule, count(*) - count({c}) AS violations FROM twice"
                for c in ("timestamp", "visitorid", "event", "itemid", "transactionid")
            )
            + """ UNION ALL SELECT 'length(event<=50)', count(*) FILTER (WHERE length(event) > 50) FROM twice
                  UNION ALL SELECT 'unique(id)', count(*) - count(DISTINCT id) FROM twice
                  UNION ALL SELECT 'unique(timestamp,visitorid,event,itemid)',
                                   CAST(sum(cnt - 1) AS BIGINT) FROM copies""",
        ),
        "data_quality_report": _with(
            CS,
            f"""r AS (
              SELECT 'not_empty' AS check_name, CAST(count(*) = 0 AS BIGINT) AS n_bad FROM cs
              UNION ALL SELECT 'duplicates', count(*) FROM (
                SELECT 1 FROM cs GROUP BY timestamp, visitorid, event, itemid HAVING count(*) > 1)
              UNION ALL SELECT 'event_types', count(DISTINCT event) FROM cs WHERE event NOT IN {KNOWN}
              UNION ALL SELECT 'required_values', count(*) FROM cs
                WHERE timestamp IS NULL OR visitorid IS NULL OR event IS NULL OR itemid IS NULL)""",
            "SELECT check_name, n_bad = 0 AS passed, n_bad FROM r",
        ),
        "classify_errors": _with(
            _classified(), "SELECT batch_id, error_type, severity FROM classified"
        ),
        "error_events": _with(
            _classified(),
            """SELECT error_type, text AS error_message, severity,
                      raw_data, batch_id,
                      CAST(0 AS BIGINT) AS retry_count, 'pending' AS status FROM classified""",
        ),
        "error_alerts": _with(
            _classified(),
            """SELECT 'E-commerce Spark Error Alert' AS username,
                      if(severity = 'CRITICAL', 'danger', 'warning') AS color,
                      if(severity = 'CRITICAL', ':rotating_light:', ':warning:')
                        || ' ' || severity || ' - ' || error_type AS title,
                      text, CAST(batch_id AS VARCHAR) AS batch_id,
                      'Spark Streaming Consumer' AS footer
               FROM classified WHERE severity IN ('CRITICAL', 'ERROR')""",
        ),
        "failed_message_count": """SELECT count(*) AS failed_messages FROM events
                                   WHERE event_type = 'error'""",
    }


# --- messages that are damaged or odd, by their id
HOSTILE = """base AS (
  SELECT *, id % 20 AS kind, '{"timestamp":' || timestamp || ',"visitorid":' || visitorid || ',"event":"' || event
            || '","itemid":' || itemid || ',"transactionid":' AS head,
         coalesce(CAST(transactionid AS VARCHAR), 'null') AS t FROM cs),
whole AS (SELECT *, head || t || '}' AS json FROM base),
hostile AS (
  SELECT *, CASE WHEN kind BETWEEN 1 AND 5 THEN 'invalid' ELSE 'valid' END AS outcome,
    CASE kind WHEN 1 THEN replace(json, '"timestamp":' || timestamp, '"timestamp":9223372036854775807')
      WHEN 2 THEN json || ' garbage' WHEN 3 THEN json || json WHEN 4 THEN json || '],[' || json
      WHEN 5 THEN '' ELSE json END AS v,
    CASE kind WHEN 6 THEN 'T-4000' WHEN 7 THEN '4000.7' WHEN 8 THEN '4000'
      ELSE CAST(transactionid AS VARCHAR) END AS tid,
    timestamp || '|' || visitorid || '|' || event || '|' || itemid || '|' || coalesce(tid, '-') AS told
  FROM whole)"""
JSON_FIELDS = """'{"timestamp":' || timestamp || ',"visitorid":' || visitorid || ',"event":"' || event
       || '","itemid":' || itemid"""
JSON_VALUE = f"""{JSON_FIELDS} || ',"transactionid":' || coalesce(CAST(transactionid AS VARCHAR), 'null') || '}}'"""


def ingest():
    unpivoted = " UNION ALL ".join(
        f"SELECT p_partkey AS itemid, '{c}' AS property, CAST({c} AS VARCHAR) AS value FROM part"
        for c in ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    )
    return {
        "event_messages": _with(
            CS, f"SELECT CAST(visitorid AS VARCHAR) AS key, {JSON_VALUE} AS value FROM cs"
        ),
        "parse_events": _with(
            CS,
            """SELECT timestamp, visitorid, event, itemid, CAST(transactionid AS VARCHAR) AS transactionid,
                      make_timestamp(timestamp * 1000) AS event_time FROM cs WHERE event <> 'error'""",
        ),
        "nan_to_null": """SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value
                          FROM events""",
        "failed_batch_records": _with(
            CS,
            f"""SELECT {JSON_FIELDS} || coalesce(',"transactionid":' || transactionid, '')
                       || ',"error_message":"connection refused","batch_id":7}}' AS value FROM cs""",
        ),
        "load_category_tree": """SELECT CAST(r_regionkey AS BIGINT) AS categoryid,
                                        CAST(NULL AS BIGINT) AS parentid FROM region
                                 UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation""",
        "load_item_properties": unpivoted,
        "parse_hostile_messages": _with(
            CS, HOSTILE, "SELECT outcome, CASE outcome WHEN 'valid' THEN told ELSE v END AS content FROM hostile"
        ),
        "read_events_csv": _with(
            CS,
            """SELECT timestamp, visitorid, event, itemid, CAST(transactionid AS DOUBLE) AS transactionid
               FROM cs""",
        ),
        "failed_message_log": _with(
            CS,
            f"""SELECT CAST(visitorid AS VARCHAR) AS partition_key,
                       CASE event WHEN 'error' THEN left(v, length(v) - 1) ELSE v END AS raw_message,
                       CASE WHEN event <> 'error' THEN itemid END AS itemid, 'TimeoutError' AS error_type,
                       'no answer for ' || visitorid AS error_message
                FROM (SELECT *, {JSON_VALUE} AS v FROM cs) WHERE visitorid % 3 = 0""",
        ),
        "consume_events": _with(
            CS, HOSTILE,
            """SELECT timestamp, visitorid, event, itemid, tid AS transactionid,
                      coalesce(tid IN ('T-4000', '4000.7'), FALSE) AS rejected
               FROM hostile WHERE outcome = 'valid'""",
        ),
        "failed_sink_batches": _with(
            CS,
            """SELECT timestamp, visitorid, event, itemid, CAST(transactionid AS VARCHAR) AS transactionid,
                      'ConnectionError: connection refused' AS error_message, 'danger' AS color,
                      'ConnectionError: connection refused' AS text FROM cs WHERE event <> 'error'""",
        ),
    }


PLACED = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY visitorid ORDER BY timestamp, id) AS rn,
         count(*) OVER (PARTITION BY visitorid) AS n FROM cs)"""
KEPT = "greatest(1, floor(n * CAST(0.8 AS DOUBLE)))"
TIMED = """timed AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY timestamp, id)
                      <= floor((SELECT count(*) FROM cs) * CAST(0.8 AS DOUBLE))
                 THEN 'train' ELSE 'test' END AS part FROM cs)"""
USER_FEATURES = """uf AS (
  SELECT visitorid, count(itemid) AS total_events,
         count(*) FILTER (WHERE event = 'transaction') AS purchase_count,
         min(timestamp) AS first_event_time, max(timestamp) AS last_event_time,
         CAST(count(*) FILTER (WHERE event = 'transaction') AS DOUBLE) / count(itemid) AS conversion_rate,
         (max(timestamp) - min(timestamp)) / CAST(1000 AS DOUBLE) / CAST(86400 AS DOUBLE) AS activity_days
  FROM cs GROUP BY visitorid)"""
ITEM_POPULARITY = "ip AS (SELECT itemid, count(*) AS item_popularity FROM cs GROUP BY itemid)"


def training():
    in_training = f"SELECT * EXCLUDE (rn, n) FROM placed WHERE rn <= {KEPT}"
    sequences = _with(
        CS,
        """s AS (
          SELECT visitorid, itemid AS target,
                 row_number() OVER (PARTITION BY visitorid ORDER BY timestamp, id) AS position,
                 list(itemid) OVER (PARTITION BY visitorid ORDER BY timestamp, id
                                    ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS items FROM cs)""",
        """SELECT visitorid, position, array_to_string(items, ',') AS sequence, target
           FROM s WHERE position > 10""",
    )
    def active(least):
        return f"""SELECT * FROM cs WHERE visitorid IN (
                     SELECT visitorid FROM cs GROUP BY visitorid HAVING count(*) >= {least})"""

    return {
        "active_user_events": _with(CS, active(3)),
        "active_buyer_events": _with(BUYS, active(40)),
        "user_features": _with(CS, USER_FEATURES, "SELECT * FROM uf"),
        "item_popularity": _with(CS, ITEM_POPULARITY, "SELECT * FROM ip"),
        "event_features": _with(
            CS, USER_FEATURES, ITEM_POPULARITY,
            """SELECT cs.* EXCLUDE (t), t AS datetime, extract('hour' FROM t) AS hour,
                      extract('isodow' FROM t) - 1 AS dayofweek, event = 'view' AS event_view,
                      event = 'addtocart' AS event_addtocart, event = 'transaction' AS event_transaction,
                      uf.* EXCLUDE (visitorid), item_popularity
               FROM (SELECT *, make_timestamp(timestamp * 1000) AS t FROM cs) cs
               JOIN uf USING (visitorid) JOIN ip USING (itemid)""",
        ),
        "train_split": _with(CS, PLACED, in_training),
        "train_split_by_range": _with(CS, PLACED, in_training),
        "test_split": _with(CS, PLACED, f"SELECT * EXCLUDE (rn, n) FROM placed WHERE rn > {KEPT}"),
        "time_split": _with(CS, TIMED, "SELECT * FROM timed"),
        "split_summary": _with(
            CS, TIMED,
            """counts AS (
                 SELECT count(*) FILTER (WHERE part = 'train') AS train_events,
                        count(*) FILTER (WHERE part = 'test') AS test_events,
                        count(DISTINCT visitorid) FILTER (WHERE part = 'train') AS train_users,
                        count(DISTINCT visitorid) FILTER (WHERE part = 'test') AS test_users,
                        (SELECT count(*) FROM (SELECT visitorid FROM timed GROUP BY visitorid
                                               HAVING count(DISTINCT part) = 2)) AS common_users
                 FROM timed)""",
            """SELECT *, CAST(100 AS DOUBLE) * (CAST(train_events AS DOUBLE) / (train_events + test_events)) AS train_percent,
                      CAST(100 AS DOUBLE) * (CAST(test_events AS DOUBLE) / (train_events + test_events)) AS test_percent,
                      CAST(100 AS DOUBLE) * (CAST(common_users AS DOUBLE) / test_users) AS common_percent
               FROM counts""",
        ),
        "item_sequences": sequences,
        "item_sequences_by_range": sequences,
    }


def _ratings(source="cs"):
    return f"""ratings AS (
  SELECT visitorid, itemid,
         CAST(sum(CASE event WHEN 'view' THEN 1 WHEN 'addtocart' THEN 2 ELSE 3 END) AS BIGINT) AS rating
  FROM {source} WHERE event IN {KNOWN} GROUP BY visitorid, itemid)"""


SIMILARITY = """norms AS (SELECT itemid, sum(rating * rating) AS norm FROM ratings GROUP BY itemid),
dots AS (
  SELECT a.itemid AS item_i, b.itemid AS item_j, sum(a.rating * b.rating) AS dot
  FROM ratings a JOIN ratings b ON a.visitorid = b.visitorid AND a.itemid <> b.itemid GROUP BY ALL),
sims AS (
  SELECT item_i, item_j,
         CAST(dot AS DOUBLE) / sqrt(CAST(ni.norm AS DOUBLE) * CAST(nj.norm AS DOUBLE)) AS similarity
  FROM dots JOIN norms ni ON ni.itemid = item_i JOIN norms nj ON nj.itemid = item_j)"""
def _neighbours(n=10):
    return f"""nb AS (
  SELECT item_i AS itemid, item_j AS neighbour, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY similarity DESC, item_j) AS rank FROM sims)
  WHERE rank <= {n})"""


NEIGHBOURS = _neighbours()


def _recommended(source="cs", users="SELECT DISTINCT visitorid FROM cs", n=10):
    return f"""{_ratings(source)},
{SIMILARITY},
{_neighbours(n)},
pop AS (SELECT itemid, row_number() OVER (ORDER BY count(*) DESC, itemid) AS place
        FROM {source} GROUP BY itemid),
wanted AS ({users}),
alike AS (
  SELECT visitorid, rank, itemid FROM (
    SELECT r.visitorid, nb.neighbour AS itemid,
           row_number() OVER (PARTITION BY r.visitorid
             ORDER BY count(*) DESC, min(r.itemid * 100 + nb.rank)) AS rank
    FROM ratings r JOIN wanted USING (visitorid) JOIN nb ON nb.itemid = r.itemid
    WHERE NOT EXISTS (SELECT 1 FROM ratings o WHERE o.visitorid = r.visitorid AND o.itemid = nb.neighbour)
    GROUP BY r.visitorid, nb.neighbour) WHERE rank <= {n}),
found AS (SELECT visitorid, count(*) AS n FROM alike GROUP BY visitorid),
filled AS (
  SELECT visitorid, coalesce(n, 0) + free AS rank, itemid FROM (
    SELECT w.visitorid, f.n, p.itemid,
           row_number() OVER (PARTITION BY w.visitorid ORDER BY p.place) AS free
    FROM wanted w LEFT JOIN found f USING (visitorid) CROSS JOIN pop p
    WHERE coalesce(f.n, 0) < {n}
      AND NOT EXISTS (SELECT 1 FROM ratings o WHERE o.visitorid = w.visitorid AND o.itemid = p.itemid)
      AND NOT EXISTS (SELECT 1 FROM alike s WHERE s.visitorid = w.visitorid AND s.itemid = p.itemid))
  WHERE coalesce(n, 0) + free <= {n}),
offered AS (SELECT *, 'similar' AS source FROM alike UNION ALL SELECT *, 'popular' FROM filled)"""


def recommendations():
    cold = """SELECT c_custkey AS visitorid FROM customer
              WHERE c_custkey NOT IN (SELECT visitorid FROM cs)"""
    train = f"train AS (SELECT * FROM placed WHERE rn <= {KEPT})"
    bought = f"""bought AS (SELECT DISTINCT visitorid, itemid FROM placed
                            WHERE rn > {KEPT} AND event = 'transaction')"""
    known = "SELECT DISTINCT visitorid FROM bought WHERE visitorid IN (SELECT visitorid FROM train)"
    return {
        "user_item_ratings": _with(CS, _ratings(), "SELECT * FROM ratings"),
        "item_similarity": _with(CS, _ratings(), SIMILARITY, "SELECT * FROM sims"),
        "item_similarity_blocked": _with(CS, _ratings(), SIMILARITY, "SELECT * FROM sims"),
        "item_neighbours": _with(CS, _ratings(), SIMILARITY, NEIGHBOURS, "SELECT * FROM nb"),
        "purchase_item_neighbours": _with(BUYS, _ratings(), SIMILARITY, NEIGHBOURS, "SELECT * FROM nb"),
        "recommend_users": _with(CS, _recommended(), "SELECT * FROM offered"),
        "recommend_buyers": _with(BUYS, _recommended(), "SELECT * FROM offered"),
        "recommend_cold_users": _with(CS, _recommended(users=cold), "SELECT * FROM offered"),
        "recommend_untrained": _with(
            CS,
            """top AS (SELECT itemid, row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
                       FROM cs GROUP BY itemid ORDER BY rank LIMIT 10)""",
            """SELECT c_custkey AS visitorid, rank, itemid, 'popular' AS source
               FROM customer CROSS JOIN top""",
        ),
        "hit_rate": _with(
            CS, PLACED, train, bought, _recommended("train", known),
            """tally AS (
                 SELECT (SELECT count(*) FROM wanted) AS k,
                        (SELECT count(DISTINCT visitorid) FROM bought) AS b,
                        (SELECT count(DISTINCT visitorid) FROM bought
                         JOIN offered USING (visitorid, itemid)) AS h)""",
            """SELECT k AS evaluated_users, b - k AS skipped_users, h AS hits,
                      CASE WHEN k = 0 THEN 0 ELSE CAST(h AS DOUBLE) / k END AS hit_rate FROM tally""",
        ),
    }


def streams():
    late = """arrived AS (
      SELECT *, FALSE AS late FROM cs
      UNION ALL (SELECT *, FALSE FROM cs ORDER BY timestamp DESC, id DESC LIMIT 1)
      UNION ALL SELECT *, TRUE FROM cs WHERE event = 'transaction')"""
    still_open = "NOT late OR s * 60000 + 300000 > (SELECT ms FROM newest_time) - 600000"
    sold_twice = """sold AS (SELECT * FROM cs WHERE event = 'transaction'
                             UNION ALL SELECT * FROM cs WHERE event = 'transaction')"""
    newest_windows = f"""SELECT {WINDOW_COLUMNS} FROM ws WHERE event <> 'transaction'
                         UNION ALL SELECT {WINDOW_COLUMNS} FROM ws2"""
    total_columns = "event, total_count, unique_visitors, unique_items"
    return {
        "stream_raw_events": _with(
            CS,
            """SELECT timestamp, visitorid, event, itemid, CAST(transactionid AS VARCHAR) AS transactionid,
                      strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS event_date
               FROM cs WHERE event <> 'error'""",
        ),
        "dead_letter_events": _with(
            CS,
            f"""SELECT left(v, length(v) - 1) AS raw_message, 'JSON parsing failed' AS error_message
                FROM (SELECT {JSON_VALUE} AS v FROM cs WHERE event = 'error')""",
        ),
        "stream_windowed_stats": _with(CS, _windows(), "SELECT * FROM ws"),
        "stream_event_statistics": _with(CS, _totals(), f"SELECT {total_columns} FROM es"),
        "stream_late_data": _with(
            CS, AS_OF, late, _windows("arrived", extra=still_open), "SELECT * FROM ws"
        ),
        "upsert_windowed_stats": _with(
            CS, sold_twice, _windows(), _windows("sold", "ws2"), newest_windows
        ),
        "upsert_event_statistics": _with(
            CS, sold_twice, _totals(), _totals("sold", "es2"),
            f"""SELECT {total_columns} FROM es WHERE event <> 'transaction'
                UNION ALL SELECT {total_columns} FROM es2""",
        ),
    }


def all_queries() -> dict[str, str]:
    named = {
        **statistics(), **profile(), **checks(), **ingest(), **training(), **recommendations(), **streams()
    }
    names = ", ".join(f"'{n}'" for n in CATEGORY_NAMES)
    return named | {
        # the same rows by another way
        "handle_errors": named["error_alerts"],
        "saved_event_features": named["event_features"],
        "pipeline_restarted": named["stream_raw_events"],
        "fan_out_events": named["stream_raw_events"],
        "stream_pane_windows": named["stream_windowed_stats"],
        "upsert_daily_windows": named["upsert_windowed_stats"],
        "stream_exact_statistics": _with(
            BUYS,
            """SELECT event, count(*) AS total_count, count(DISTINCT visitorid) AS unique_visitors,
                      count(DISTINCT itemid) AS unique_items FROM cs GROUP BY event""",
        ),
        "fan_out_totals": _with(
            CS, HOSTILE,
            """SELECT event, count(*) AS total_count, count(DISTINCT visitorid) AS unique_visitors,
                      count(DISTINCT itemid) AS unique_items FROM hostile WHERE outcome = 'valid' GROUP BY event""",
        ),
        "stream_health": _with(
            CS, HOSTILE,
            """SELECT count(*) AS messages, count_if(outcome = 'valid')::BIGINT AS valid,
                      count_if(outcome = 'invalid')::BIGINT AS invalid FROM hostile""",
        ),
        "upsert_incomplete_batch": named["upsert_event_statistics"],
        "refit_neighbours": named["item_neighbours"],
        "refit_recommend_buyers": named["recommend_buyers"],
        "recommend_more": _with(CS, _recommended(n=15), "SELECT * FROM offered"),
        "approx_distinct_bound": _with(
            BUYS,
            """SELECT event, 'transactionid' AS counted, count(DISTINCT transactionid) AS exact,
                      TRUE AS within_bound FROM cs GROUP BY event
               UNION ALL SELECT event, 'itemid', count(DISTINCT itemid), TRUE FROM cs GROUP BY event""",
        ),
        "category_distribution_all": _with(
            BUYS, "top AS (SELECT itemid, count(*) AS clicks FROM cs GROUP BY itemid)",
            f"""SELECT category, clicks,
                       {_percent('clicks', '(SELECT sum(clicks) FROM top)', 0)} AS percentage
                FROM (SELECT ([{names}])[itemid % 20 + 1] AS category,
                             CAST(sum(clicks) AS BIGINT) AS clicks FROM top GROUP BY 1)""",
        ),
    }
