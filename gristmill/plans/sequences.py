"""Queries over time and turns: clusters, sessions, look-backs, contexts, history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import running
from gristmill.plans.registry import query, read


@query("""WITH e AS (SELECT *, round((value - 50) * 10000)::BIGINT AS v FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
  f AS (SELECT *, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)::INT AS fresh FROM e),
  r AS (SELECT event_id, coalesce(sum(fresh) OVER w, 0)::BIGINT AS n_elements, coalesce(sum(v) OVER w, 0) / 10000 AS total, coalesce(sum(abs(v)) OVER x, 0) AS weight FROM f
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, least(1.0, CASE WHEN weight > 0 THEN n_elements * 0.1 + total * 0.1 WHEN n_elements > 0 THEN n_elements * 0.1 - total * 0.1 / n_elements END) AS c FROM r)
  SELECT event_id, n_elements, round(total, 4) AS total, round(CASE WHEN c > 0.1 THEN c END, 6) AS cluster_score FROM s""")
def cluster_scores(spark, sf_dir):
    out = running.clusters(read(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", F.col("value") - 50)
    return out.select("event_id", "n_elements", F.round("total", 4).alias("total"), F.round("cluster_score", 6).alias("cluster_score"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
  SELECT user_id, epoch_us(min(ts)) // 1000000 AS began, epoch_us(max(ts) + INTERVAL 2 HOUR) // 1000000 AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_seconds("s.start").alias("began"), F.unix_seconds("s.end").alias("ended"), "n")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 21600000000 AS h FROM events), x AS (SELECT event_type, h * 21600 AS start FROM e UNION ALL SELECT event_type, (h - 1) * 21600 FROM e)
  SELECT event_type, start, count(*) AS n FROM x GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "12 hours", "6 hours")
    return read(spark, sf_dir, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_seconds("w.start").alias("start"), "n")


@query("""WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT event_type, sum(n)::BIGINT AS hits, round(avg(n), 6) AS frequency, round(stddev_pop(n), 6) AS deviation FROM h GROUP BY 1""")
def event_frequencies(spark, sf_dir):
    """Hits of each type, and their mean and deviation over the hours that have any."""
    hours = read(spark, sf_dir, "events").groupBy("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("h")).agg(F.count("*").alias("n"))
    return hours.groupBy("event_type").agg(F.sum("n").alias("hits"), F.round(F.avg("n"), 6).alias("frequency"), F.round(F.stddev_pop("n"), 6).alias("deviation"))


@query("""SELECT event_id, count(*) OVER w AS recent, count(*) FILTER (event_type = 'error') OVER w AS recent_errors FROM events WHERE user_id IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def recent_counts(spark, sf_dir):
    counts = {"recent": F.count("*"), "recent_errors": F.count(F.when(F.col("event_type") == "error", 1))}
    return running.look_back(read(spark, sf_dir, "events"), ["user_id"], "ts", 21_600, counts, slot_s=86_400).select("event_id", *counts)


#: Turns of context, and turns to a slot of one conversation.
CONTEXT, SLOT = 3, 64


@query("""SELECT a.conv_id, a.turn, count(b.turn) AS n_context, md5(coalesce(string_agg(b.role || ':' || b.text, chr(10) ORDER BY b.turn, b.role, b.text), '')) AS context_md5
  FROM (SELECT DISTINCT conv_id, turn FROM conversations) a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 3 AND a.turn - 1 GROUP BY 1, 2""")
def conversation_context(spark, sf_dir):
    """What a reader of each turn has before it: the turns numbered up to three less.

    A conversation of any length is cut into slots of turns; the last turns of a
    slot are copied into the next one, so no task holds a whole conversation.
    """
    turns = read(spark, sf_dir, "conversations").dropna(subset=["conv_id", "turn"]).withColumn("own", F.floor(F.col("turn") / SLOT))
    turns = turns.withColumn("slot", F.explode(F.sequence("own", F.floor((F.col("turn") + CONTEXT) / SLOT))))
    before = Window.partitionBy("conv_id", "slot").orderBy("turn").rangeBetween(-CONTEXT, -1)
    said = F.struct("turn", "role", "text")
    rows = turns.withColumn("c", F.array_sort(F.collect_list(said).over(before))).filter("slot = own").dropDuplicates(["conv_id", "turn"])
    text = F.array_join(F.transform("c", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return rows.select("conv_id", "turn", F.size("c").cast("long").alias("n_context"), F.md5(text.cast("binary")).alias("context_md5"))


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE regexp_matches(text, '[Qq]ue'))""")
def matching_sessions(spark, sf_dir):
    """All turns of the conversations in which any turn matches."""
    turns = read(spark, sf_dir, "conversations")
    hit = turns.filter(F.col("text").rlike("[Qq]ue")).select("conv_id").distinct()
    return turns.join(hit, "conv_id", "left_semi").select("conv_id", "turn", "role")


@query("""SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50""")
def history_page(spark, sf_dir):
    """The second page of fifty rows, newest first."""
    return read(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(50).limit(50).select("event_id", "user_id", "event_type")


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE epoch_us(ts) // 86400000000 % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE epoch_us(ts) // 86400000000 % 2 = 1 GROUP BY 1)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.user_id = b.user_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def compared_results(spark, sf_dir):
    """Two runs' results side by side, and where they differ: here the even and the odd days."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    rows = read(spark, sf_dir, "events").filter("user_id is not null").groupBy("user_id").agg(F.count_if(day % 2 == 0).alias("n_left"), F.count_if(day % 2 == 1).alias("n_right"))
    return rows.withColumn("change", F.col("n_right") - F.col("n_left")).filter("change != 0")
