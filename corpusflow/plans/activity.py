"""Chat, exam, upload, token and request-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import exams as E
from corpusflow.operators import joins as J
from corpusflow.operators import ordered as O
from corpusflow.operators import reports as R
from corpusflow.operators import windows as W
from corpusflow.plans.common import ORACLES, query, table

# --- chat ------------------------------------------------------------------------

@query(
    "chat_history",
    """
    WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC,
                 CASE role WHEN 'user' THEN 2 ELSE 3 END DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n
               FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT conv_id, CAST(least(n, 4) - r AS INTEGER) AS position, role, text FROM k WHERE r <= 4""",
)
def chat_history(spark, sf_dir):
    """Last four messages per conversation, oldest first."""
    turns = table(spark, sf_dir, "conversations")
    return W.last_messages(turns, "conv_id", "turn", keep=4).select("conv_id", "position", "role", "text")


@query(
    "chat_history_default",
    """
    WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC,
                 CASE role WHEN 'user' THEN 2 ELSE 3 END DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n
               FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT conv_id, CAST(least(n, 12) - r AS INTEGER) AS position, role, text FROM k WHERE r <= 12""",
)
def chat_history_default(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return W.last_messages(turns, "conv_id", "turn").select("conv_id", "position", "role", "text")


@query(
    "transcript",
    """
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn,
             CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 4 END) - 1 AS INTEGER) AS position, role, text
    FROM conversations""",
)
def transcript(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return W.transcript(turns, "conv_id", "turn", width=4).select("conv_id", "position", "role", "text")


_ROLLING = """
    SELECT conv_id, turn, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') AS context
    FROM conversations"""


@query("rolling_context", _ROLLING.format(n=3))
def rolling_context(spark, sf_dir):
    """The three turns before each turn, in blocks of four."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return W.rolling_context(turns, "conv_id", "turn", "text", previous=3, width=4).drop("text")


@query("rolling_context_default", _ROLLING.format(n=6))
def rolling_context_default(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return W.rolling_context(turns, "conv_id", "turn", "text").drop("text")


@query(
    "turn_assignment",
    """
    WITH p AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS slot,
                      count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
    SELECT conv_id, turn, n_name AS participant FROM conversations
    JOIN p ON n_regionkey = conv_id % 5 AND slot = turn % n""",
)
def turn_assignment(spark, sf_dir):
    """Nations of a region take turns."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("grp"), "n_nationkey", F.col("n_name").alias("participant"))
    order = W.positions(nation, ["grp"], [F.col("n_nationkey")], F.col("n_nationkey"), 1_000, "slot").drop("n_nationkey")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 5).cast("int").alias("grp"))
    return J.round_robin(turns, order, "turn", "grp").select("conv_id", "turn", "participant")


@query(
    "token_usage",
    """
    SELECT conv_id % 50 AS user_id, conv_id AS session_id,
      CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS prompt_tokens,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS completion_tokens,
      CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens
    FROM conversations GROUP BY ALL""",
)
def token_usage(spark, sf_dir):
    tokens = F.floor(F.char_length("text") / 4)
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 50).alias("user_id"), F.col("conv_id").alias("session_id"),
        F.when(F.col("role") != "assistant", tokens).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", tokens).alias("completion_tokens"),
    )
    return R.token_usage(turns, "user_id", "session_id")


@query(
    "sessions_recent",
    """
    SELECT user_id, event_type AS session_id, max(ts) AS updated_at FROM events WHERE event_type <> 'error' GROUP BY ALL""",
)
def sessions_recent(spark, sf_dir):
    """Sessions of one tool per user, latest activity first."""
    events = table(spark, sf_dir, "events").where("event_type <> 'error'")
    latest = events.groupBy("user_id", F.col("event_type").alias("session_id")).agg(F.max("ts").alias("updated_at"))
    return latest.orderBy("user_id", F.desc("updated_at"))


@query(
    "uploads_recent",
    "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'",
)
def uploads_recent(spark, sf_dir):
    uploads = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return uploads.orderBy("user_id", F.desc("ts"), F.desc("event_id"))


@query(
    "ownership",
    """
    SELECT e.event_id, CASE WHEN o_orderkey IS NULL OR o_orderstatus = 'P' THEN '404' WHEN o_custkey % 3 <> e.user_id % 3 THEN '403' ELSE 'ok' END AS access
    FROM events e LEFT JOIN orders ON o_orderkey = e.event_id * 2""",
)
def ownership(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") * 2).alias("session_id"), (F.col("user_id") % 3).alias("caller")
    )
    sessions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), (F.col("o_custkey") % 3).alias("owner"), "o_orderstatus"
    )
    found = J.ownership(requests, sessions, "session_id", "caller", "owner", F.col("o_orderstatus") != "P")
    return found.select("event_id", "access")


@query(
    "attachment_binding",
    """
    WITH m AS (SELECT event_id AS message_id, user_id % 4 AS user_id, user_id % 2 AS session_id,
                      list_transform(range(0, event_id % 7 + 1), lambda i: (event_id * 3 + (i * i) % 4) % 16000) AS ids FROM events),
    u AS (SELECT message_id, user_id, session_id, len(ids) > 5 AS too_many, ids, unnest(list_distinct(ids)) AS attachment_id FROM m),
    j AS (SELECT u.*, o_orderkey, o_custkey % 4 AS owner, CASE o_orderstatus WHEN 'F' THEN o_custkey % 2 WHEN 'O' THEN -1 END AS stored
          FROM u LEFT JOIN orders ON o_orderkey = attachment_id),
    f AS (SELECT attachment_id, min(message_id) AS first_message, arg_min(session_id, message_id) AS first_session FROM j
          WHERE NOT too_many AND owner = user_id AND stored IS NULL GROUP BY 1)
    SELECT message_id, j.attachment_id, CASE WHEN too_many THEN '422' WHEN o_orderkey IS NULL THEN '404' WHEN owner <> user_id THEN '403'
        WHEN stored IS NULL AND message_id = first_message THEN 'bind' WHEN coalesce(stored, first_session) = session_id THEN 'ok' ELSE '409' END AS outcome
    FROM j LEFT JOIN f ON f.attachment_id = j.attachment_id""",
)
def attachment_binding(spark, sf_dir):
    key = F.col("event_id")
    ids = F.transform(F.sequence(F.lit(0), key % 7), lambda i: (key * 3 + (i * i) % 4) % 16000)
    messages = table(spark, sf_dir, "events").select(
        key.alias("message_id"), (F.col("user_id") % 4).alias("user_id"), (F.col("user_id") % 2).alias("session_id"), ids.alias("ids")
    )
    status = F.col("o_orderstatus")
    files = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attachment_id"), (F.col("o_custkey") % 4).alias("user_id"),
        F.when(status == "F", F.col("o_custkey") % 2).when(status == "O", F.lit(-1)).alias("session_id"),
    )
    return J.bind_attachments(messages, files).select("message_id", "attachment_id", "outcome")


@query(
    "owner_backfill",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE o_custkey END AS owner
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def owner_backfill(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")).alias("owner")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    return J.owner_backfill(items, orders, "l_orderkey", "owner")


@query(
    "orphans",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)",
)
def orphans(spark, sf_dir):
    bound = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.orphans(table(spark, sf_dir, "part").select("p_partkey"), bound, "p_partkey")


# --- exams -----------------------------------------------------------------------

def question_bank(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("board"), F.col("o_orderstatus").alias("subject"),
        F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("question_id"),
    )


_MIX = """
    bank AS (SELECT o_orderpriority AS board, o_orderstatus AS subject, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS question_id FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY board, subject, year ORDER BY md5('11|' || question_id), question_id) AS rnd FROM bank),
    d AS (SELECT *, row_number() OVER (PARTITION BY board, subject ORDER BY rnd, year) AS deal FROM r),
    m AS (SELECT board, subject, year, question_id, CAST(row_number() OVER (PARTITION BY board, subject ORDER BY md5('11:order|' || question_id), question_id) - 1 AS INTEGER) AS position
          FROM d WHERE deal <= 20)"""


@query("exam_mix", f"WITH {_MIX} SELECT * FROM m")
def exam_mix(spark, sf_dir):
    return E.mix_questions(question_bank(spark, sf_dir), 20, 11)


@query("exam_delivery", f"WITH {_MIX} SELECT board, subject, 20 AS requested, count(*) AS delivered FROM m GROUP BY ALL")
def exam_delivery(spark, sf_dir):
    return E.requested_delivered(E.mix_questions(question_bank(spark, sf_dir), 20, 11), 20)


def _marked(spark, sf_dir):
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    bank = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("question_id"), F.element_at(letters, F.col("p_size") % 4 + 1).alias("correct_option")
    )
    taken = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("question_id"),
        F.try_element_at(letters, F.col("l_quantity").cast("int") % 5 + 1).alias("selected_option"),
    )
    return E.mark_answers(taken, bank)


_MARKED = """
    a AS (SELECT l_orderkey AS session_id, l_linenumber AS position, l_partkey AS question_id,
                 ['A','B','C','D'][CAST(l_quantity AS INTEGER) % 5 + 1] AS selected_option, ['A','B','C','D'][p_size % 4 + 1] AS correct_option
          FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "exam_score",
    f"""
    WITH {_MARKED},
    s AS (SELECT session_id, count(*) FILTER (selected_option = correct_option) AS correct, count(*) AS total FROM a GROUP BY 1)
    SELECT o_orderkey AS session_id, coalesce(correct, 0) AS correct, coalesce(total, 0) AS total,
           CAST(round_even(100.0 * coalesce(correct, 0) / greatest(coalesce(total, 0), 1), 0) AS INTEGER) AS score
    FROM orders LEFT JOIN s ON session_id = o_orderkey""",
)
def exam_score(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    return E.exam_scores(sessions, _marked(spark, sf_dir))


@query(
    "exam_corrections",
    f"""
    WITH {_MARKED} SELECT session_id, position, question_id, selected_option, correct_option FROM a
    WHERE selected_option IS DISTINCT FROM correct_option""",
)
def exam_corrections(spark, sf_dir):
    return E.corrections(_marked(spark, sf_dir)).select("session_id", "position", "question_id", "selected_option", "correct_option")


# --- uploads ---------------------------------------------------------------------

@query(
    "used_bytes",
    """
    SELECT c_custkey AS user_id, CAST(coalesce(n, 0) AS BIGINT) AS used_bytes FROM customer
    LEFT JOIN (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey""",
)
def used_bytes(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    uploads = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        "user_id", F.round(F.col("value") * 100).cast("long").alias("size_bytes")
    )
    return R.used_bytes(users, uploads)


@query(
    "quota_admission",
    """
    WITH RECURSIVE u AS (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) - 300 AS size,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (
      SELECT event_id, user_id, rn, CASE WHEN size <= 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' WHEN size > 60000 THEN 'over_quota' ELSE 'accepted' END AS outcome,
             CASE WHEN size > 0 AND size <= 20000 THEN size ELSE 0 END AS used FROM u WHERE rn = 1
      UNION ALL
      SELECT u.event_id, u.user_id, u.rn,
             CASE WHEN size <= 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' WHEN used + size > 60000 THEN 'over_quota' ELSE 'accepted' END,
             used + CASE WHEN size > 0 AND size <= 20000 AND used + size <= 60000 THEN size ELSE 0 END
      FROM w JOIN u ON u.user_id = w.user_id AND u.rn = w.rn + 1)
    SELECT event_id, user_id, outcome FROM w""",
)
def quota_admission(spark, sf_dir):
    """Every event as an upload against a small quota."""
    uploads = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", (F.round(F.col("value") * 100).cast("long") - 300).alias("size")
    )
    cut = O.with_segment(uploads, O.seconds(F.col("ts")), 3 * 86_400)
    done = O.quota_admission(cut, "user_id", [F.col("ts"), F.col("event_id")], "size", quota=60_000, max_item=20_000)
    return done.select("event_id", "user_id", "outcome")


# --- failures --------------------------------------------------------------------

_STREAKS = """
    i AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed,
            sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events),
    s AS (SELECT *, CASE WHEN failed THEN CAST(sum(failed::INT) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS INTEGER) ELSE 0 END AS streak FROM i)"""


def streaks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    cut = O.with_segment(events, O.seconds(F.col("ts")), 86_400)
    return O.failure_streak(cut, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")


@query(
    "failure_streaks",
    f"WITH {_STREAKS} SELECT event_id, streak, CASE WHEN streak >= 3 THEN CAST(least(300 * streak, 1800) AS INTEGER) END AS cool_down FROM s",
)
def failure_streaks(spark, sf_dir):
    return streaks(spark, sf_dir).select("event_id", "streak", O.cool_down_seconds(F.col("streak")).alias("cool_down"))


@query(
    "source_rest",
    f"WITH {_STREAKS} SELECT event_id, CASE WHEN streak > 0 AND streak % 3 = 0 THEN ts + INTERVAL 1800 SECOND END AS resting_until FROM s",
)
def source_rest(spark, sf_dir):
    return streaks(spark, sf_dir).select("event_id", O.source_rest_until(F.col("ts"), F.col("streak")).alias("resting_until"))


# --- requests and tokens -----------------------------------------------------------

@query(
    "rate_limit",
    """
    WITH RECURSIVE e AS (SELECT event_id, user_id, event_type AS path, epoch_us(ts) AS us,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    w AS (
      SELECT event_id, user_id, path, rn, us AS opened, CAST(1 AS BIGINT) AS hit_no, us FROM e WHERE rn = 1
      UNION ALL
      SELECT e.event_id, e.user_id, e.path, e.rn, CASE WHEN e.us >= opened + 172800000000 THEN e.us ELSE opened END,
             CASE WHEN e.us >= opened + 172800000000 THEN 1 ELSE hit_no + 1 END, e.us
      FROM w JOIN e ON e.user_id = w.user_id AND e.path = w.path AND e.rn = w.rn + 1)
    SELECT event_id, hit_no, hit_no <= 2 AS allowed,
           CASE WHEN hit_no > 2 THEN CAST(greatest(1, floor((opened + 172800000000 - us) / 1000000.0 + 0.5)) AS INTEGER) END AS retry_after
    FROM w""",
)
def rate_limit(spark, sf_dir, **how):
    """Two hits per user and path in two days from the first hit."""
    hits = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("path"), "ts")
    decided = O.first_hit_windows(
        hits, ["user_id", "path"], "ts", "event_id", limit=2, window_seconds=172_800, segment_seconds=7 * 86_400, **how
    )
    return decided.select("event_id", "hit_no", "allowed", "retry_after")


@query("rate_limit_segments", ORACLES["rate_limit"])
def rate_limit_segments(spark, sf_dir):
    """The same with every key cut into segments, as busy keys are."""
    return rate_limit(spark, sf_dir, hot_rows=0)


@query(
    "token_validity",
    """
    WITH t AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 3600 SECOND END AS used,
                 lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nxt FROM events),
    v AS (SELECT *, least(nxt, ts + INTERVAL 172800 SECOND, used) AS valid_until FROM t)
    SELECT event_id, valid_until, CASE WHEN valid_until = used THEN 'consumed' WHEN valid_until = nxt THEN 'superseded' ELSE 'expired' END AS ended_by FROM v""",
)
def token_validity(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts",
        F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 3600 SECOND")).alias("used"),
    )
    valid = W.token_validity(tokens, ["user_id", "event_type"], "ts", "used", 172_800, "event_id")
    return valid.select("event_id", "valid_until", "ended_by")


@query(
    "session_epoch",
    """
    WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)
    SELECT event_id, epoch, ts - to_seconds(CAST(floor(value * 3600) AS BIGINT)) AS issued_at,
           coalesce(date_trunc('second', ts - to_seconds(CAST(floor(value * 3600) AS BIGINT))) < date_trunc('second', epoch), false) AS revoked
    FROM e WHERE event_type <> 'signup'""",
)
def session_epoch(spark, sf_dir):
    """A sign-up starts a new epoch; tokens issued before it are revoked."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    issued = F.col("ts") - F.make_dt_interval(secs=F.floor(F.col("value") * 3600))
    uses = W.session_epochs(events, "user_id", "ts", "event_id", F.col("event_type") == "signup", issued)
    return uses.select("event_id", "epoch", "issued_at", "revoked")


@query(
    "single_use",
    """
    SELECT user_id * 100 + CAST(floor(value) AS BIGINT) AS jti, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1""",
)
def single_use(spark, sf_dir):
    claims = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 100 + F.floor("value")).alias("jti"), "event_id", "ts"
    )
    return W.single_use(claims, "jti", [F.col("ts"), F.col("event_id")]).select("jti", "event_id")
