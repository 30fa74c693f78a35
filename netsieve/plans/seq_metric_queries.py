"""Registered sequence, metric, event-log and streaming queries
(W2-W4, A16-A18, A20-A25, J5, F6, F7, T5, C18-C20, R1-R9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsieve.functions.expressions import is_attack, rounded, sigmoid
from netsieve.operators import metrics as M
from netsieve.operators import sequence as Q
from netsieve.plans.registry import register
from netsieve.plans.sql import FLOWS_CTE, r6, with_ctes
from netsieve.session import path_exists, scratch_path
from netsieve.sources.flows import FEATURES, flows, with_binary_score, with_synthetic_prediction
from netsieve.streaming import messages as MSG
from netsieve.streaming import scoring as SC
from netsieve.streaming import sessions as SES

from netsieve.plans.prep_queries import DAY_SQL, MINMAX_CTES

SEQ_CTES = [*MINMAX_CTES, "scaled AS (SELECT row_id, label, split, " + ", ".join(
    f"({c} - lo_{c}) / r_{c} AS {c}" for c in FEATURES) + " FROM gp JOIN (SELECT row_id, label FROM flows) l USING (row_id) CROSS JOIN mm)"]
DAY_CTES = [*DAY_SQL, """w AS (SELECT split, row_id AS start,
  max(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END) OVER f AS is_attack, sum(fwd_iat_mean) OVER f AS iat,
  count(*) OVER f AS n FROM scaled
  WINDOW f AS (PARTITION BY split ORDER BY row_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))"""]
FWD = FEATURES.index("total_fwd_packets")
BWD = FEATURES.index("total_bwd_packets")
IAT = FEATURES.index("fwd_iat_mean")


def _int_seq(seq_col, idx):
    return F.array_join(F.transform(seq_col, lambda x: x[idx].cast("bigint").cast("string")), ",")


def _total(seq_col, idx):
    """Sum of one feature over a sequence."""
    return rounded(F.aggregate(seq_col, F.lit(0.0), lambda a, x: a + x[idx]))


# ---- sequences ------------------------------------------------------------------------

@register("tumbling_sequences", with_ctes(
    FLOWS_CTE,
    "b AS (SELECT row_id // 10 AS sequence_id, * FROM flows)",
    "lab AS (SELECT sequence_id, label FROM (SELECT sequence_id, label, row_number() OVER ("
    "PARTITION BY sequence_id ORDER BY count(*) DESC, label) AS rn FROM b "
    "GROUP BY sequence_id, label) t WHERE rn = 1)") + f"""
SELECT sequence_id, min(row_id) AS first_row, count(*) AS n_rows, any_value(lab.label) AS label,
  string_agg(CAST(total_fwd_packets AS VARCHAR), ',' ORDER BY row_id) AS fwd_seq,
  string_agg(CAST(total_bwd_packets AS VARCHAR), ',' ORDER BY row_id) AS bwd_seq,
  {r6('sum(fwd_iat_mean)')} AS iat_sum
FROM b JOIN lab USING (sequence_id) GROUP BY sequence_id HAVING count(*) = 10""")
def tumbling_sequences(spark, sf_dir):
    s = Q.tumbling_sequences(flows(spark, sf_dir), "row_id", FEATURES, "label", 10)
    return s.select("sequence_id", "first_row", "n_rows", "label",
                    _int_seq("seq", FWD).alias("fwd_seq"), _int_seq("seq", BWD).alias("bwd_seq"),
                    F.round(F.aggregate(F.transform("seq", lambda x: x[IAT]), F.lit(0.0),
                                        lambda a, b: a + b), 6).alias("iat_sum"))


@register("sliding_sequences", with_ctes(FLOWS_CTE) + """
SELECT start, n_rows, is_attack, fwd_seq FROM (
  SELECT row_id AS start,
    count(*) OVER w AS n_rows,
    max(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END) OVER w AS is_attack,
    array_to_string(list(CAST(total_fwd_packets AS VARCHAR)) OVER w, ',') AS fwd_seq
  FROM flows WINDOW w AS (ORDER BY row_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) t
WHERE n_rows = 5""")
def sliding_sequences(spark, sf_dir):
    s = Q.sliding_sequences(flows(spark, sf_dir), "row_id", FEATURES, "label", 5)
    return s.select("start", "n_rows", "is_attack", _int_seq("seq", FWD).alias("fwd_seq"))


# Composed datasets.  Preparation -> split -> scale on train -> windows inside each split -> tensors.

def _windows_sql(split: str, length: int) -> str:
    """Tumbling windows of ``scaled``, numbered inside each split, with the majority label."""
    return f"""
i AS (SELECT *, row_number() OVER (PARTITION BY {split} ORDER BY row_id) - 1 AS pos FROM scaled),
b AS (SELECT *, pos // {length} AS seq FROM i),
lab AS (SELECT {split}, seq, label FROM (SELECT {split}, seq, label, row_number() OVER (
  PARTITION BY {split}, seq ORDER BY count(*) DESC, label) AS rn FROM b GROUP BY {split}, seq, label) t WHERE rn = 1)"""


@register("sequence_dataset", with_ctes(
    *SEQ_CTES, _windows_sql("split", 10).strip()) + f"""
SELECT split, min(row_id) AS first_row, any_value(lab.label) AS label,
  {r6('sum(fwd_iat_mean)')} AS iat_sum, {r6('max(total_fwd_packets)')} AS max_fwd
FROM b JOIN lab USING (split, seq) GROUP BY split, seq HAVING count(*) = 10""")
def sequence_dataset(spark, sf_dir):
    """W2 + M5 + X7 + W3 + K3: clean, split by sequence group, min-max on train, full windows per split, written."""
    from netsieve.plans.prep_queries import minmax_prepared
    from netsieve.sources.sinks import materialize
    rows = minmax_prepared(spark, sf_dir)
    parts = None
    for split in ("train", "test"):
        seqs = Q.tumbling_sequences(rows.where(F.col("split") == split), "row_id", FEATURES, "label", 10)
        seqs = seqs.withColumn("split", F.lit(split))
        parts = seqs if parts is None else parts.unionByName(seqs)
    tensors = materialize(parts, "sequence-dataset", partition_by=("split",))
    return tensors.select("split", "first_row", "label", _total("seq", IAT).alias("iat_sum"),
                          rounded(F.array_max(F.transform("seq", lambda x: x[FWD]))).alias("max_fwd"))


@register("day_split_windows", with_ctes(*DAY_CTES) + f"""
SELECT split, start, is_attack, {r6('iat')} AS iat_sum FROM w WHERE n = 5""")
def day_split_windows(spark, sf_dir):
    """M6 + W4: fill 0, clip, min-max on train days, split by day, number each part anew, sliding windows."""
    from netsieve.plans.prep_queries import day_prepared
    rows = day_prepared(spark, sf_dir)
    parts = None
    for split in ("train", "test"):
        w = Q.sliding_sequences(rows.where(F.col("split") == split), "row_id", FEATURES, "label", 5)
        w = w.select(F.lit(split).alias("split"), "start", "is_attack", _total("seq", IAT).alias("iat_sum"))
        parts = w if parts is None else parts.unionByName(w)
    return parts


# ---- metrics on the stand-in predictions ----------------------------------------------

PRED_CTE = """p AS (SELECT row_id, label, CASE WHEN row_id % 7 = 0 THEN 'BENIGN'
  WHEN row_id % 11 = 0 THEN 'DDoS' ELSE label END AS prediction FROM flows)"""
PRED_B_CTE = """pb AS (SELECT row_id, label, CASE WHEN row_id % 5 = 0 THEN 'Bot'
  ELSE label END AS prediction FROM flows)"""


def _counts_cte(name: str, src: str) -> str:
    return f"""{name} AS (SELECT class, sum(t) AS support, sum(q) AS n_pred, sum(tp) AS tp FROM (
  SELECT label AS class, 1 AS t, 0 AS q, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp FROM {src}
  UNION ALL SELECT prediction AS class, 0 AS t, 1 AS q, 0 AS tp FROM {src}) x GROUP BY class),
{name}_m AS (SELECT class, support, tp,
  CASE WHEN n_pred = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n_pred END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall FROM {name}),
{name}_f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
  ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM {name}_m)"""


def _pred(spark, sf_dir):
    return with_synthetic_prediction(flows(spark, sf_dir).select("row_id", "label"))


def _pred_b(spark, sf_dir):
    return with_synthetic_prediction(flows(spark, sf_dir).select("row_id", "label"),
                                     benign_every=10 ** 12, ddos_every=10 ** 12) \
        .withColumn("prediction", F.when(F.col("row_id") % 5 == 0, F.lit("Bot"))
                    .otherwise(F.col("label")))


@register("confusion_matrix", with_ctes(FLOWS_CTE, PRED_CTE) + """
SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction""")
def confusion_matrix(spark, sf_dir):
    return M.confusion(_pred(spark, sf_dir), "label", "prediction")


@register("per_class_metrics", with_ctes(FLOWS_CTE, PRED_CTE, _counts_cte("c", "p")) + f"""
SELECT class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
  CAST(support AS BIGINT) AS support FROM c_f""")
def per_class_metrics(spark, sf_dir):
    return M.per_class(_pred(spark, sf_dir), "label", "prediction")


@register("macro_metrics", with_ctes(FLOWS_CTE, PRED_CTE, _counts_cte("c", "p")) + f"""
SELECT {r6('CAST(sum(tp) AS DOUBLE) / sum(support)')} AS accuracy,
  {r6('avg(precision)')} AS macro_precision, {r6('avg(recall)')} AS macro_recall,
  {r6('avg(f1)')} AS macro_f1, CAST(sum(support) AS BIGINT) AS n FROM c_f""")
def macro_metrics(spark, sf_dir):
    return M.macro(_pred(spark, sf_dir), "label", "prediction")


@register("classification_report", with_ctes(FLOWS_CTE, PRED_CTE, _counts_cte("c", "p")) + f"""
SELECT class, {r6('precision', 4)} AS precision, {r6('recall', 4)} AS recall, {r6('f1', 4)} AS f1,
  CAST(support AS BIGINT) AS support FROM c_f
UNION ALL
SELECT 'accuracy', NULL, NULL, {r6('CAST(sum(tp) AS DOUBLE) / sum(support)', 4)},
  CAST(sum(support) AS BIGINT) FROM c_f
UNION ALL
SELECT 'macro avg', {r6('avg(precision)', 4)}, {r6('avg(recall)', 4)}, {r6('avg(f1)', 4)},
  CAST(sum(support) AS BIGINT) FROM c_f
UNION ALL
SELECT 'weighted avg', {r6('sum(precision * support) / sum(support)', 4)},
  {r6('sum(recall * support) / sum(support)', 4)}, {r6('sum(f1 * support) / sum(support)', 4)},
  CAST(sum(support) AS BIGINT) FROM c_f""")
def classification_report(spark, sf_dir):
    return M.report(_pred(spark, sf_dir), "label", "prediction", 4)


@register("binary_threshold_metrics", with_ctes(FLOWS_CTE, """b AS (
  SELECT CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END AS y,
         CASE WHEN 1.0 / (1.0 + exp(-ln(s / (1 - s)))) >= 0.3 THEN 1 ELSE 0 END AS pred
  FROM (SELECT label, (total_fwd_packets + 1) / 101.0 AS s FROM flows) t)""",
    """c AS (SELECT count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
  count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn,
  count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn FROM b)""",
    """m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM c)""") + f"""
SELECT tp, fp, fn, tn, {r6('precision')} AS precision, {r6('recall')} AS recall,
  {r6('CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END')}
  AS f1, {r6('CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn)')} AS accuracy FROM m""")
def binary_threshold_metrics(spark, sf_dir):
    df = with_binary_score(flows(spark, sf_dir).select("label", "total_fwd_packets"))
    logit = F.log(F.col("score") / (F.lit(1.0) - F.col("score")))
    df = df.select(is_attack("label").alias("y"), sigmoid(logit).alias("prob"))
    return M.binary(df.withColumn("pred", M.threshold("prob", 0.3)), "y", "pred")


@register("compare_models", with_ctes(FLOWS_CTE, PRED_CTE, PRED_B_CTE, _counts_cte("ca", "p"),
                                      _counts_cte("cb", "pb")) + f"""
SELECT coalesce(a.class, b.class) AS class,
  {r6('a.precision')} AS a_precision, {r6('a.recall')} AS a_recall, {r6('a.f1')} AS a_f1,
  {r6('b.precision')} AS b_precision, {r6('b.recall')} AS b_recall, {r6('b.f1')} AS b_f1
FROM ca_f a FULL OUTER JOIN cb_f b ON a.class = b.class""")
def compare_models(spark, sf_dir):
    a = M.per_class(_pred(spark, sf_dir), "label", "prediction")
    b = M.per_class(_pred_b(spark, sf_dir), "label", "prediction")
    return M.compare(a, b, "a", "b")


# ---- messages, event log, stream ----------------------------------------------------------

MSG_CTE = """m AS (SELECT row_id, ts, total_fwd_packets AS k, src_ip,
  '10.0.0.' || CAST(destination_port % 256 AS VARCHAR) AS dst_ip,
  CASE total_fwd_packets % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP'
    WHEN 3 THEN 'HTTP' ELSE 'HTTPS' END AS protocol,
  CAST(64 + destination_port % 1437 AS INTEGER) AS length,
  strftime(ts, '%H:%M:%S') AS timestamp,
  CASE WHEN least(fwd_iat_mean, 1e6) > 100 THEN 1 ELSE 0 END AS prediction
  FROM flows)"""
LAST50_SQL = with_ctes(FLOWS_CTE, MSG_CTE) + """
SELECT row_id, src_ip, dst_ip, protocol, length, timestamp, prediction,
  CASE WHEN prediction = 1 THEN 'high' ELSE 'low' END AS severity,
  CASE WHEN prediction = 1 THEN 'MALICIOUS' ELSE 'ACK' END AS flag
FROM m WHERE k NOT IN (3, 4, 5, 6) ORDER BY ts DESC, row_id DESC LIMIT 50"""
LOG_COLS = ["row_id", "src_ip", "dst_ip", "protocol", "length", "timestamp", "prediction",
            "severity", "flag"]


_FILES: dict = {}
#: Messages in one file at most, about: a file is written and read by one task.
FILE_ROWS = 250_000


def message_files(spark, sf_dir, files: int = 8) -> str:
    """The messages derived from the tables, stored once as ``files`` parquet files, or more as they grow.

    Messages are data at rest (the broker's log); parsing them straight out of
    the generating plan would let the optimizer inline to_json/from_json into
    pushed-down filters, so both the batch log and the stream read the files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _FILES:
        path = f"{scratch_path(spark, 'messages')}/messages"
        messages = MSG.message_table(spark, sf_dir)
        batch = max(1, -(-messages.count() // (files * FILE_ROWS)))
        (messages.repartitionByRange(files * batch, "row_id")
         .sortWithinPartitions("row_id").write.parquet(path))
        _FILES[key] = (path, batch)
    return _FILES[key][0]


def message_stream(spark, sf_dir, files: int = 8):
    """The stored messages as a stream, an equal share of the files per micro-batch (about ``files`` batches)."""
    path = message_files(spark, sf_dir, files)
    batch = _FILES[spark.sparkContext.applicationId, sf_dir, files][1]
    return MSG.read_stream(spark, path, options={"maxFilesPerTrigger": str(batch)})


@register("recent_events", LAST50_SQL)
def recent_events(spark, sf_dir):
    stored = spark.read.schema(MSG.TRANSPORT).parquet(message_files(spark, sf_dir))
    checked = MSG.validate(MSG.parse(stored))
    scored = SC.score(checked.where(F.col("reject_reason").isNull()), SC.rule_model())
    return SC.newest(SC.event_log_rows(scored)).select(*LOG_COLS)


_RUNS: dict = {}


def stream_run(spark, sf_dir):
    """Drain the stored messages, in about eight micro-batches, through the scorer."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _RUNS:
        return _RUNS[key]
    base = scratch_path(spark, "stream")
    SC.run(message_stream(spark, sf_dir), f"{base}/out", f"{base}/checkpoint")
    _RUNS[key] = f"{base}/out"
    return _RUNS[key]


COUNTERS_SQL = with_ctes(FLOWS_CTE, MSG_CTE, """c AS (SELECT count(*) AS total,
  count(*) FILTER (WHERE prediction = 1) AS malicious, count(*) FILTER (WHERE prediction = 0) AS benign,
  CAST(0 AS BIGINT) AS suspicious FROM m WHERE k NOT IN (4, 5, 6))""")


@register("stream_counters", COUNTERS_SQL + """
SELECT total, malicious, benign, suspicious FROM c""")
def stream_counters(spark, sf_dir):
    return SC.latest_state(spark, stream_run(spark, sf_dir), "counters")


@register("stream_threat_level", COUNTERS_SQL + """
SELECT CASE WHEN malicious > 0 THEN 'CRITICAL' ELSE 'NOMINAL' END AS threat_level,
  round(CAST(benign AS DOUBLE) * 100 / greatest(total, 1), 2) AS benign_pct FROM c""")
def stream_threat_level(spark, sf_dir):
    c = SC.latest_state(spark, stream_run(spark, sf_dir), "counters")
    return SC.threat_view(c).select("threat_level", "benign_pct")


@register("stream_last50", LAST50_SQL)
def stream_last50(spark, sf_dir):
    return SC.latest_state(spark, stream_run(spark, sf_dir), "last50").select(*LOG_COLS)


@register("stream_rejects", with_ctes(FLOWS_CTE) + """
SELECT row_id, CASE total_fwd_packets WHEN 4 THEN 'json' WHEN 5 THEN 'length' ELSE 'value' END AS reason
FROM flows WHERE total_fwd_packets IN (4, 5, 6)""")
def stream_rejects(spark, sf_dir):
    return SC.all_batches(spark, stream_run(spark, sf_dir), "rejects").select("row_id", "reason")


# ---- training history ---------------------------------------------------------------------

HIST_CTE = """h AS (SELECT CAST(epoch AS BIGINT) AS epoch, avg(recall) AS metric FROM (
  SELECT epoch, class, CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall
  FROM (SELECT epoch, class, sum(t) AS support, sum(tp) AS tp FROM (
    SELECT dayofmonth(ts) - 1 AS epoch, label AS class, 1 AS t,
           CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp FROM p
    UNION ALL SELECT dayofmonth(ts) - 1, prediction, 0, 0 FROM p) x GROUP BY epoch, class) y) z
  GROUP BY epoch)"""


@register("early_stop_history", with_ctes(
    FLOWS_CTE,
    PRED_CTE.replace("SELECT row_id, label,", "SELECT row_id, ts, label,"),
    HIST_CTE).replace("WITH ", "WITH RECURSIVE ", 1) + """,
s AS (
  SELECT epoch, metric, CASE WHEN metric > 0.0 + 1e-6 THEN metric ELSE 0.0 END AS best,
    CASE WHEN metric > 0.0 + 1e-6 THEN 1 ELSE 0 END AS improved,
    CASE WHEN metric > 0.0 + 1e-6 THEN 0 ELSE 1 END AS bad
  FROM h WHERE epoch = (SELECT min(epoch) FROM h)
  UNION ALL
  SELECT h.epoch, h.metric, CASE WHEN h.metric > s.best + 1e-6 THEN h.metric ELSE s.best END,
    CASE WHEN h.metric > s.best + 1e-6 THEN 1 ELSE 0 END,
    CASE WHEN h.metric > s.best + 1e-6 THEN 0 ELSE s.bad + 1 END
  FROM s JOIN h ON h.epoch = (SELECT min(epoch) FROM h h2 WHERE h2.epoch > s.epoch)
  WHERE s.bad < 5),
fin AS (SELECT max(epoch) FILTER (WHERE improved = 1) AS best_e,
  min(epoch) FILTER (WHERE bad >= 5) AS stop_e FROM s)
SELECT 'synthetic' AS run, epoch, round(metric, 6) + 0.0 AS metric, round(best, 6) + 0.0 AS best,
  improved, bad AS epochs_no_improve,
  CASE WHEN epoch = best_e THEN 1 ELSE 0 END AS is_best,
  CASE WHEN epoch = stop_e THEN 1 ELSE 0 END AS stopped
FROM s CROSS JOIN fin""")
def early_stop_history(spark, sf_dir):
    from netsieve.operators.history import early_stopping
    p = with_synthetic_prediction(flows(spark, sf_dir).select("row_id", "ts", "label"))
    p = p.withColumn("epoch", (F.dayofmonth("ts") - 1).cast("bigint"))
    rec = F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.lit(1).alias("t"),
                 F.when(F.col("label") == F.col("prediction"), 1).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("t"), F.lit(0).alias("tp"))))
    per = (p.select("epoch", rec.alias("r")).select("epoch", "r.*")
           .groupBy("epoch", "class").agg(F.sum("t").alias("support"), F.sum("tp").alias("tp")))
    recall = F.when(F.col("support") == 0, 0.0).otherwise(F.col("tp") / F.col("support"))
    hist = per.groupBy("epoch").agg(F.avg(recall).alias("metric")) \
              .withColumn("run", F.lit("synthetic"))
    out = early_stopping(hist, "run", "epoch", "metric", patience=5, min_delta=1e-6)
    return out.select("run", "epoch", F.round("metric", 6).alias("metric"),
                      F.round("best", 6).alias("best"), "improved", "epochs_no_improve",
                      "is_best", "stopped")


@register("event_time_sequences", with_ctes(FLOWS_CTE) + """
SELECT src_ip, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS n_rows, max(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END) AS is_attack,
  string_agg(CAST(total_fwd_packets AS VARCHAR), ',' ORDER BY ts, row_id) AS fwd_seq
FROM flows GROUP BY src_ip, time_bucket(INTERVAL '1 hour', ts)""")
def event_time_sequences(spark, sf_dir):
    s = Q.event_time_sequences(flows(spark, sf_dir), ["src_ip"], "ts", FEATURES, "label",
                               window="1 hour", order_col="row_id")
    return s.select("src_ip", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")
                    .alias("window_start"), "n_rows", "is_attack",
                    _int_seq("seq", FWD).alias("fwd_seq"))


@register("event_time_chunks", with_ctes(FLOWS_CTE) + """
SELECT src_ip, dst_ip, strftime(w, '%Y-%m-%d') AS window_start, chunk, count(*) AS n_rows,
  max(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END) AS is_attack,
  string_agg(CAST(total_fwd_packets AS VARCHAR), ',' ORDER BY ts, row_id) AS fwd_seq
FROM (SELECT *, (row_number() OVER (PARTITION BY src_ip, dst_ip, w ORDER BY ts, row_id) - 1) // 2 AS chunk
  FROM (SELECT *, '10.0.0.' || CAST(destination_port % 4 AS VARCHAR) AS dst_ip,
    time_bucket(INTERVAL '1 day', ts) AS w FROM flows) a) b
GROUP BY src_ip, dst_ip, w, chunk""")
def event_time_chunks(spark, sf_dir):
    """W7 by address pair, at most two flows a sequence."""
    f = flows(spark, sf_dir).withColumn(
        "dst_ip", F.concat(F.lit("10.0.0."), (F.col("destination_port") % 4).cast("string")))
    s = Q.event_time_chunks(f, ["src_ip", "dst_ip"], "ts", FEATURES, "label", "row_id", "1 day", max_rows=2)
    return s.select("src_ip", "dst_ip", F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "chunk",
                    "n_rows", "is_attack", _int_seq("seq", FWD).alias("fwd_seq"))


SESSION_GAP_S, SESSION_ROWS = 6 * 3600, 3
#: Flows of a micro-batch, of a file of it, and of a bucket of entities in all batches together.
SESSION_BATCH_ROWS, SESSION_FILE_ROWS, SESSION_BUCKET_ROWS = 4_000_000, 250_000, 10_000
SESSION_SQL = with_ctes(FLOWS_CTE, """
a AS (SELECT *, '10.0.0.' || CAST(destination_port % 4 AS VARCHAR) AS dst_ip FROM flows),
b AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM a
  WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts, row_id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS s FROM b),
d AS (SELECT *, min(ts) OVER (PARTITION BY src_ip, dst_ip, s) AS session_start,
  (row_number() OVER (PARTITION BY src_ip, dst_ip, s ORDER BY ts, row_id) - 1) // 3 AS chunk FROM c)""") + """
SELECT src_ip, dst_ip, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start, chunk, count(*) AS n_rows,
  max(CASE WHEN label = 'BENIGN' THEN 0 ELSE 1 END)::INTEGER AS is_attack,
  string_agg(CAST(total_fwd_packets AS VARCHAR), ',' ORDER BY ts, row_id) AS fwd_seq
FROM d GROUP BY src_ip, dst_ip, s, session_start, chunk"""


def _pair_flows(spark, sf_dir):
    return flows(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "dst_ip", F.concat(F.lit("10.0.0."), (F.col("destination_port") % 4).cast("string")))


def _session_rows(s):
    return s.select("src_ip", "dst_ip", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "chunk", "n_rows",
                    "is_attack", _int_seq("seq", FWD).alias("fwd_seq"))


@register("session_chunks", SESSION_SQL)
def session_chunks(spark, sf_dir):
    """Gap sessions by address pair, at most three flows a chunk."""
    return _session_rows(SES.session_chunks(_pair_flows(spark, sf_dir), ["src_ip", "dst_ip"], "ts", "row_id", FEATURES, "label",
                                            SESSION_GAP_S, SESSION_ROWS))


@register("session_chunks_stream", SESSION_SQL)
def session_chunks_stream(spark, sf_dir):
    """W7 on a stream: the same sessions from state and timers, over batches of files in time order.

    The last batch holds one flow far in the future, so that the watermark passes all others; its own session stays open.
    """
    base = scratch_path(spark, "sessions")
    f = _pair_flows(spark, sf_dir).select("src_ip", "dst_ip", "ts", "row_id", "label", *FEATURES)
    lo, hi, n = f.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count(F.lit(1))).first()
    parts = max(4, -(-n // SESSION_BATCH_ROWS))
    slot = F.floor((F.unix_seconds("ts") - lo) * parts / (hi - lo + 1))
    (f.where("ts is not null").withColumn("slot", slot).repartition(F.col("slot"), F.pmod("row_id", F.lit(-(-n // (parts * SESSION_FILE_ROWS)))))
     .write.partitionBy("slot").parquet(f"{base}/slots"))
    slots = spark.read.schema(f.schema).option("basePath", f"{base}/slots")
    end = f.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(hi + 10 * SESSION_GAP_S))).withColumn("src_ip", F.lit("end of stream"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, SES.ROCKSDB)
    try:
        for i in range(parts + 1):
            if i < parts and not path_exists(spark, f"{base}/slots/slot={i}"):
                continue
            (slots.parquet(f"{base}/slots/slot={i}") if i < parts else end.coalesce(1)).write.mode("append").parquet(f"{base}/src")
            # A run takes all files that are new; state and watermark go on from the checkpoint.
            found = SES.stream_session_chunks(spark.readStream.schema(f.schema).parquet(f"{base}/src"), ["src_ip", "dst_ip"], "ts", "row_id",
                                              FEATURES, "label", SESSION_GAP_S, "1 hour", SESSION_ROWS, buckets=max(16, n // SESSION_BUCKET_ROWS))
            q = (found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return _session_rows(spark.read.parquet(f"{base}/out"))
