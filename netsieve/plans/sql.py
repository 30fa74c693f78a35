"""SQL building blocks for the oracle side (ANSI SQL as run by DuckDB).

The ``flows`` CTE is the SQL twin of ``netsieve.sources.flows.flows``.
"""

from netsieve.sources.flows import DOUBLE_FEATURES, FEATURES

FLOWS_CTE = """
flows AS (
  SELECT event_id AS row_id, ts,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'BENIGN'
         WHEN event_type = 'purchase' THEN 'DDoS'
         WHEN value > 100 THEN 'PortScan' ELSE 'Bot' END AS label,
    CAST(floor((value - 10) * 100) AS BIGINT) AS flow_duration,
    k AS total_fwd_packets,
    CAST(floor(value) AS BIGINT) AS total_bwd_packets,
    CAST((event_id * 7919) % 65535 AS BIGINT) AS destination_port,
    CASE WHEN k = 0 THEN CAST('Infinity' AS DOUBLE) WHEN k = 1 THEN NULL
         WHEN k = 2 THEN CAST('NaN' AS DOUBLE) ELSE value * 1000 / k END AS flow_bytes_s,
    CAST(0 AS BIGINT) AS bwd_psh_flags,
    k AS fwd_header_length,
    value AS fwd_iat_mean,
    value * 2 + CAST(k AS DOUBLE) / 100 AS fwd_iat_max,
    '192.168.1.' || CAST(user_id AS VARCHAR) AS src_ip,
    dayname(ts) AS day,
    dayname(ts) || '-flows.csv' AS source_file
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
)"""


def nn(c: str) -> str:
    """NaN -> NULL for a fractional feature, identity otherwise."""
    if c in DOUBLE_FEATURES:
        return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
    return c


def nn_inf(c: str) -> str:
    """NaN and +/-inf -> NULL for a fractional feature."""
    if c in DOUBLE_FEATURES:
        return f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"
    return c


def clean_cte(src: str = "flows", name: str = "clean") -> str:
    """Flows with NaN/inf -> NULL in every fractional feature."""
    cols = ", ".join(f"{nn_inf(c)} AS {c}" if c in DOUBLE_FEATURES else c for c in FEATURES)
    return f"{name} AS (SELECT row_id, ts, label, {cols}, src_ip, day, source_file FROM {src})"


def r6(expr: str, digits: int = 6) -> str:
    """Round a double and fold -0.0 into 0.0 (twin of ``rounded``)."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def hash_key(id_expr: str, seed: int = 42) -> str:
    return f"md5(CAST({id_expr} AS VARCHAR) || ':{seed}')"


def class_rank(id_col: str = "row_id", part: str | None = "label", seed: int = 42) -> str:
    """0-based rank in md5 order inside ``part`` (the oracle twin of ``hash_rank``)."""
    over = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({over}ORDER BY {hash_key(id_col, seed)}, {id_col}) - 1"


def class_size(part: str | None = "label") -> str:
    return f"count(*) OVER (PARTITION BY {part})" if part else "count(*) OVER ()"


def strat_split_cte(name: str = "s", src: str = "flows") -> str:
    """row_id, label, split with ceil(20 %) of every class in test."""
    return f"""{name} AS (SELECT row_id, label,
  CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT row_id, label, {class_rank()} AS rk, {class_size()} AS n FROM {src}) r)"""


def group_split_cte(name: str = "g", src: str = "flows") -> str:
    """row_id, sequence_id, split with ceil(20 %) of the sequence ids in test."""
    return f"""{name} AS (SELECT f.row_id, f.row_id // 10 AS sequence_id, gs.split FROM {src} f JOIN (
  SELECT sequence_id, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT sequence_id, {class_rank('sequence_id', None)} AS rk, {class_size(None)} AS n
    FROM (SELECT DISTINCT row_id // 10 AS sequence_id FROM {src}) d) r) gs
  ON f.row_id // 10 = gs.sequence_id)"""


def median_fill_cte(name: str, src: str, split_src: str, cols) -> str:
    """Columns of ``src`` as double with NULLs filled by the train-split median."""
    meds = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in cols)
    fills = ", ".join(f"coalesce(CAST(x.{c} AS DOUBLE), m.m_{c}) AS {c}" for c in cols)
    return f"""{name}_m AS (SELECT {meds} FROM {src} JOIN {split_src} USING (row_id) WHERE split = 'train'),
{name} AS (SELECT x.row_id, sp.split, {fills} FROM {src} x JOIN {split_src} sp USING (row_id)
  CROSS JOIN {name}_m m)"""
