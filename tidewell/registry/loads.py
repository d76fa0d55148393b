"""Checked queries: change application, incremental reads, load modes, schemas."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.masking import apply_masking
from tidewell.model import (
    CDC_OP,
    CDC_SEQ,
    CDC_TS,
    add_cdc_meta,
    drop_prefix,
    normalize_identifier,
    normalize_type,
    payload_columns,
    positional_remap,
)
from tidewell.operators import incremental as I
from tidewell.operators import merge as M
from tidewell.operators import schema as S
from tidewell.operators.dedup import current_state, dedup_last_by_key
from tidewell.operators.flatten import canonicalize_values, normalize_values
from tidewell.plans import state as P
from tidewell.plans.config import run_configured
from tidewell.plans.copy_into import copy_into
from tidewell.plans.load import FrameSource, LoadJob, observed, run_job
from tidewell.plans.tables import Target, clustered
from tidewell.registry.base import query
from tidewell.registry.inputs import (
    OVERLAP_DATE,
    SPLIT_DATE,
    SQL_CHANGES,
    SQL_OP,
    SQL_ORDERS,
    SQL_TARGET,
    customer_changes,
    customer_target,
    op_of_event,
    order_batch,
    order_target,
)
from tidewell.session import fresh_dir, parallelism, read_table
from tidewell.sources.files import incremental_files as read_incremental
from tidewell.sources.files import list_files, new_files, read_detected
from tidewell.streaming.cdc import lsn_range, normalize_ops
from tidewell.streaming.cdc import split_by_table as route

ORDER_KEY = ["o_orderkey"]
CUSTOMER_KEY = ["c_custkey"]


def _tag() -> str:
    import uuid

    return uuid.uuid4().hex[:12]


def _target(spark, label, **layout) -> Target:
    return Target(spark, f"{label}_{_tag()}", fresh_dir(spark, label), **layout)


# --- the flagship -----------------------------------------------------------------------


@query(
    f"""WITH {SQL_ORDERS}
    SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice, o_orderdate,
      o_orderpriority FROM target WHERE o_orderdate < TIMESTAMP '{OVERLAP_DATE}'
    UNION ALL BY NAME
    SELECT * REPLACE (substr(o_orderpriority, 1, 1) || '***' AS o_orderpriority) FROM batch"""
)
def incremental_load(spark, sf):
    """Bounded read past the watermark, mask, stamp, keep the last event per key, merge."""
    batch = order_batch(spark, sf)
    hi = I.high_watermark_value(batch, "o_orderdate")
    rows = I.incremental_range(batch, "o_orderdate", "1997-06-30", hi)
    masked = apply_masking(rows, "orders", {"orders": {"o_orderpriority": "mask_name"}})
    events = add_cdc_meta(masked, "shop", ts=F.col("o_orderdate"), seq=F.col("o_orderkey"), ingest=False)
    target = add_cdc_meta(order_target(spark, sf), "shop", ts=F.col("o_orderdate"), ingest=False)
    merged = M.apply_changes(target, events, M.MergeRules(("o_orderkey",)))
    return merged.select(*payload_columns(target.columns))


# --- identifiers, types, values ---------------------------------------------------------


@query(
    """SELECT DISTINCT p_name, replace(p_brand || '.' || p_name, '.', '_') AS sql_name,
      lower(replace(replace(p_brand || '.' || p_name || '-' || p_type, '.', '_'), '-', '_')) AS lake_name
    FROM part""",
    name="normalize_identifier",
)
def normalize_identifier_names(spark, sf):
    dotted = F.concat_ws(".", "p_brand", "p_name")
    return (
        read_table(spark, sf, "part")
        .select(
            "p_name",
            normalize_identifier(dotted).alias("sql_name"),
            normalize_identifier(F.concat_ws("-", dotted, F.col("p_type")), lakehouse=True).alias("lake_name"),
        )
        .distinct()
    )


TYPE_NAMES = ("VARCHAR(20)", "Numeric(12, 2)", "decimal", "BIGSERIAL", "timestamp", "jsonb", "geometry", "Float64")


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
      list_extract({list(TYPE_NAMES)}, CAST(l_partkey % 8 AS INTEGER) + 1) AS type_name,
      list_extract(['string', 'decimal(12,2)', 'double', 'bigint', 'timestamp', 'string', 'string', 'double'],
                   CAST(l_partkey % 8 AS INTEGER) + 1) AS spark_type
    FROM lineitem""",
    name="normalize_type",
)
def normalize_type_names(spark, sf):
    names = F.array(*[F.lit(n) for n in TYPE_NAMES])
    picked = F.element_at(names, (F.col("l_partkey") % 8 + 1).cast("int"))
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        picked.alias("type_name"), normalize_type(picked).alias("spark_type"),
    )


@query(
    """SELECT event_id, date_trunc('milliseconds', ts) AS ts, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS value,
      lower(hex(event_type)) AS event_type FROM events""",
    name="canonicalize_values",
)
def canonicalize_event_values(spark, sf):
    events = read_table(spark, sf, "events").select(
        "event_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"),
        F.col("event_type").cast("binary").alias("event_type"),
    )
    return canonicalize_values(events)


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
      CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS value, lower(hex(event_type)) AS code,
      '[' || user_id || ',' || event_id || ']' AS ids,
      '{"kind":"' || event_type || '","user":' || user_id || '}' AS who
    FROM events""",
    name="normalize_values",
)
def normalize_event_values(spark, sf):
    events = read_table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.to_date("ts").alias("day"),
        F.col("value").cast("decimal(18,2)").alias("value"),
        F.col("event_type").cast("binary").alias("code"),
        F.array("user_id", "event_id").alias("ids"),
        F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")).alias("who"),
    )
    return normalize_values(events)


@query(
    f"""SELECT event_id, user_id, value, {SQL_OP} AS _cdc_op, 'clicks' AS _cdc_source, ts AS _cdc_ts FROM events""",
    name="add_cdc_meta",
)
def add_cdc_metadata(spark, sf):
    events = read_table(spark, sf, "events")
    return add_cdc_meta(
        events, "clicks", op=op_of_event(), ts=F.col("ts"), ingest=False
    ).select("event_id", "user_id", "value", "_cdc_op", "_cdc_source", "_cdc_ts")


@query(
    """SELECT o_orderkey, o_custkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority,
      CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_comment,
      '{"o_orderpriority":"' || o_orderpriority || '"}' AS _rescued
    FROM orders"""
)
def conform_schema(spark, sf):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority int, o_totalprice double, o_comment string"
    return S.conform(read_table(spark, sf, "orders"), T._parse_datatype_string(schema))


@query("SELECT event_id, user_id, value FROM events", name="drop_prefix")
def drop_prefixed_columns(spark, sf):
    events = read_table(spark, sf, "events")
    logged = events.select(
        "event_id", "user_id", "value",
        F.col("event_type").alias("_change_type"), F.col("ts").alias("__$start_lsn"),
    )
    return drop_prefix(logged, "_change_", "__$")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", name="positional_remap")
def positional_remap_columns(spark, sf):
    supplier = read_table(spark, sf, "supplier")
    unnamed = supplier.toDF(*[f"UNKNOWN_COL{i}" for i in range(len(supplier.columns))])
    return positional_remap(unnamed, supplier.columns)


# --- dedup and merge --------------------------------------------------------------------


@query(
    """SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC,
        l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1"""
)
def dedup_last_by_composite_key(spark, sf):
    order = (
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    return dedup_last_by_key(
        read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c).desc() for c in order]
    )


@query(f"WITH {SQL_CHANGES} SELECT * FROM latest", name="dedup_last_by_key")
def dedup_last_by_key_events(spark, sf):
    return dedup_last_by_key(customer_changes(spark, sf), CUSTOMER_KEY)


@query(f"WITH {SQL_CHANGES} SELECT * FROM latest WHERE _cdc_op <> 'delete'")
def current_state_from_log(spark, sf):
    return current_state(customer_changes(spark, sf), CUSTOMER_KEY)


@query(
    f"""WITH {SQL_ORDERS}
    SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM batch"""
)
def merge_upsert(spark, sf):
    return M.merge_upsert(order_target(spark, sf), order_batch(spark, sf), ORDER_KEY)


@query(
    f"""WITH {SQL_TARGET}, {SQL_CHANGES}
    SELECT * FROM target WHERE c_custkey NOT IN (SELECT c_custkey FROM latest WHERE _cdc_op = 'delete')"""
)
def merge_delete(spark, sf):
    latest = dedup_last_by_key(customer_changes(spark, sf), CUSTOMER_KEY)
    return M.merge_delete(customer_target(spark, sf), latest.filter("_cdc_op = 'delete'"), CUSTOMER_KEY)


@query(
    f"""WITH {SQL_TARGET}, {SQL_CHANGES}
    SELECT c_custkey, c_mktsegment, c_acctbal FROM target WHERE c_custkey NOT IN (SELECT c_custkey FROM latest)
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM latest WHERE _cdc_op <> 'delete'"""
)
def merge_full_cdc(spark, sf):
    target = customer_target(spark, sf)
    merged = M.apply_changes(target, customer_changes(spark, sf), M.MergeRules(("c_custkey",)))
    return merged.select(*target.columns)


SQL_MOVES = """
moves AS (
  SELECT event_id + (SELECT max(c_custkey) FROM customer) + 1 AS new_key, user_id AS old_key, event_type, value
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
"""


@query(
    f"""WITH {SQL_TARGET}, {SQL_MOVES}
    SELECT c_custkey, c_mktsegment, c_acctbal FROM target WHERE c_custkey NOT IN (SELECT old_key FROM moves)
    UNION ALL SELECT new_key, event_type, value FROM moves"""
)
def merge_pk_change(spark, sf):
    """The last event of every user moves that customer to a new key."""
    top = read_table(spark, sf, "customer").agg(F.max("c_custkey")).scalar()
    events = read_table(spark, sf, "events")
    last = dedup_last_by_key(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    moves = last.select(
        (F.col("event_id") + top + 1).alias("c_custkey"),
        F.col("event_type").alias("c_mktsegment"),
        F.col("value").alias("c_acctbal"),
        F.lit("update").alias(CDC_OP),
        F.col("ts").alias(CDC_TS),
        F.col("event_id").alias(CDC_SEQ),
        F.struct(F.col("user_id").alias("c_custkey")).alias("before"),
    )
    target = customer_target(spark, sf)
    return M.apply_changes(target, moves, M.MergeRules(("c_custkey",), before="before")).select(*target.columns)


@query(
    f"""WITH {SQL_TARGET}, {SQL_MOVES}
    SELECT c_custkey, c_mktsegment, c_acctbal FROM target
    WHERE c_custkey NOT IN (SELECT old_key FROM moves) AND c_custkey NOT IN (SELECT new_key FROM moves)
    UNION ALL SELECT new_key, event_type, value FROM moves"""
)
def merge_images(spark, sf):
    top = read_table(spark, sf, "customer").agg(F.max("c_custkey")).scalar()
    events = read_table(spark, sf, "events")
    last = dedup_last_by_key(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    after = last.select(
        (F.col("event_id") + top + 1).alias("c_custkey"),
        F.col("event_type").alias("c_mktsegment"),
        F.col("value").alias("c_acctbal"),
    )
    before = last.select(F.col("user_id").alias("c_custkey"))
    return M.merge_images(customer_target(spark, sf), before, after, CUSTOMER_KEY)


@query(
    f"""WITH {SQL_TARGET}, {SQL_CHANGES}
    SELECT coalesce(l.c_custkey, t.c_custkey) AS c_custkey,
      CASE WHEN l.c_custkey IS NULL THEN t.c_mktsegment
           WHEN t.c_custkey IS NOT NULL AND l.c_acctbal < 50 THEN t.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment,
      CASE WHEN l.c_custkey IS NULL THEN t.c_acctbal ELSE l.c_acctbal END AS c_acctbal
    FROM target t FULL JOIN latest l ON t.c_custkey = l.c_custkey
    WHERE l.c_custkey IS NULL OR l._cdc_op <> 'delete'"""
)
def merge_unchanged_cols(spark, sf):
    """Events of a small value did not send the segment."""
    changes = customer_changes(spark, sf).withColumn(
        "unchanged", F.when(F.col("c_acctbal") < 50, F.array(F.lit("c_mktsegment"))).otherwise(F.array())
    )
    target = customer_target(spark, sf)
    rules = M.MergeRules(("c_custkey",), unchanged="unchanged")
    return M.apply_changes(target, changes, rules).select(*target.columns)


SQL_STORED = """
stored AS (
  SELECT c_custkey, c_mktsegment, c_acctbal, 'insert' AS _cdc_op, t.ts AS _cdc_ts, CAST(-1 AS BIGINT) AS _cdc_seq
  FROM target, (SELECT max(ts) - INTERVAL 36 HOUR AS ts FROM events) t)
"""


@query(
    f"""WITH {SQL_TARGET}, {SQL_CHANGES}, {SQL_STORED}
    SELECT l.* FROM latest l LEFT JOIN stored s ON s.c_custkey = l.c_custkey
    WHERE (s.c_custkey IS NULL OR l._cdc_ts >= s._cdc_ts) AND l._cdc_op <> 'delete'
    UNION ALL BY NAME
    SELECT s.* FROM stored s LEFT JOIN latest l ON s.c_custkey = l.c_custkey
    WHERE l.c_custkey IS NULL OR l._cdc_ts < s._cdc_ts"""
)
def merge_late_guard(spark, sf):
    """Stored rows carry a time 36 hours before the last event: earlier changes are late."""
    newest = read_table(spark, sf, "events").agg(F.max("ts").alias("ts"))
    at = newest.select(F.col("ts") - F.expr("INTERVAL '36' HOUR")).scalar()
    target = customer_target(spark, sf).withColumns(
        {CDC_OP: F.lit("insert"), CDC_TS: at, CDC_SEQ: F.lit(-1).cast("bigint")}
    )
    rules = M.MergeRules(("c_custkey",), guard_late=True)
    return M.apply_changes(target, customer_changes(spark, sf), rules)


@query(
    f"""WITH {SQL_ORDERS}
    SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM batch"""
)
def merge_idempotent(spark, sf):
    """A refetched batch, merged twice."""
    batch = order_batch(spark, sf)
    once = M.merge_upsert(order_target(spark, sf), batch, ORDER_KEY)
    return M.merge_upsert(once, batch, ORDER_KEY)


@query(
    """SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_orderkey END AS l_orderkey)
    FROM lineitem WHERE l_returnflag = 'R'"""
)
def null_key_quarantine(spark, sf):
    """Rows whose key has a null part, kept apart by the merge."""
    broken = read_table(spark, sf, "lineitem").withColumn(
        "l_orderkey", F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))
    )
    return M.split_null_keys(broken, ["l_orderkey", "l_linenumber"])[1]


# --- change streams, batch form ---------------------------------------------------------

SQL_CODED = """
coded AS (
  SELECT event_id, user_id, value,
    CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS code,
    lpad(to_hex(event_id), 20, '0') AS lsn
  FROM events)
"""


def _coded(spark, sf):
    kind = F.col("event_type")
    return read_table(spark, sf, "events").select(
        "event_id", "user_id", "value",
        F.when(kind == "error", 1).when(kind == "signup", 2).when(kind == "view", 3).otherwise(4).alias("code"),
        F.lpad(F.hex("event_id"), 20, "0").alias("lsn"),
    )


@query(
    f"""WITH {SQL_CODED}
    SELECT *, CASE code WHEN 1 THEN 'delete' WHEN 2 THEN 'insert' ELSE 'update' END AS _cdc_op
    FROM coded WHERE code <> 3"""
)
def cdc_normalize_ops(spark, sf):
    return normalize_ops(_coded(spark, sf), "sqlserver", "code")


@query(
    f"""WITH {SQL_CODED}
    SELECT * FROM coded WHERE lsn > '000000000000000003E8' AND lsn <= (SELECT max(lsn) FROM coded WHERE code = 1)"""
)
def cdc_lsn_range(spark, sf):
    """Resume after position 1000, up to the last delete."""
    coded = _coded(spark, sf)
    last_delete = coded.filter("code = 1").agg(F.max("lsn")).first()[0]
    return lsn_range(coded, "lsn", "000000000000000003E8", last_delete)


@query(
    """SELECT event_id, 'public.click' AS routed FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, 'shop.purchase' FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, 'error' FROM events WHERE event_type = 'error'"""
)
def split_by_table(spark, sf):
    """Click and purchase events name their table without its schema, errors with one."""
    kind = F.col("event_type")
    events = read_table(spark, sf, "events").withColumn(
        "source_table", F.when(kind == "error", F.concat(F.lit("ops."), kind)).otherwise(kind)
    )
    routed = route(events, ["public.click", "shop.purchase", "error"])
    frames = [df.select("event_id", F.lit(t).alias("routed")) for t, df in routed.items()]
    return S.union_by_name(frames)


# --- incremental reads ------------------------------------------------------------------


@query("SELECT max(o_orderdate) AS high_watermark FROM orders")
def high_watermark(spark, sf):
    return I.high_watermark(read_table(spark, sf, "orders"), "o_orderdate")


@query(
    """SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '2000-06-30'"""
)
def incremental_range(spark, sf):
    return I.incremental_range(read_table(spark, sf, "orders"), "o_orderdate", "1997-01-01", "2000-06-30")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders
    WHERE o_orderstatus = 'P' OR o_orderdate <= TIMESTAMP '2000-06-30'"""
)
def incremental_first(spark, sf):
    """Open orders have no date yet: the first run takes them once."""
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("o_orderdate")
    )
    return I.incremental_range(orders, "o_orderdate", None, "2000-06-30")


@query(
    f"""WITH {SQL_ORDERS}
    SELECT * FROM target WHERE o_orderkey NOT IN (
        SELECT o_orderkey FROM batch WHERE o_orderdate > TIMESTAMP '{SPLIT_DATE}' - INTERVAL 10 DAY)
    UNION ALL SELECT * FROM batch WHERE o_orderdate > TIMESTAMP '{SPLIT_DATE}' - INTERVAL 10 DAY"""
)
def incremental_lookback(spark, sf):
    """Ten days before the watermark are read again; the merge absorbs the overlap."""
    batch = order_batch(spark, sf)
    rows = I.incremental_range(batch, "o_orderdate", SPLIT_DATE, lookback=10 * 86_400)
    return M.merge_upsert(order_target(spark, sf), rows, ORDER_KEY)


@query("SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00'")
def cursor_timestamp(spark, sf):
    return I.cursor_after(read_table(spark, sf, "events"), "ts", "2024-01-15T12:00:00", "timestamp")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1999-12-31'")
def cursor_date(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return I.cursor_after(orders, "day", "1999-12-31", "date")


@query("SELECT * FROM orders WHERE o_orderkey > 1234")
def cursor_integer(spark, sf):
    return I.cursor_after(read_table(spark, sf, "orders"), "o_orderkey", "1234.0", "integer")


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 > 1705320000000")
def cursor_millis(spark, sf):
    events = read_table(spark, sf, "events").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    )
    return I.cursor_after(events, "ms", "1705320000000", "millis")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE'")
def cursor_string(spark, sf):
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return I.cursor_after(customer, "c_mktsegment", "FURNITURE", "string")


@query("SELECT * FROM lineitem WHERE l_extendedprice > 50000.25")
def cursor_number(spark, sf):
    return I.cursor_after(read_table(spark, sf, "lineitem"), "l_extendedprice", "50000.25", "number")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500")
def topk_cursor(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return I.topk_cursor(orders, "o_orderdate", 500, "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 250 OFFSET 750")
def page_offset(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return I.page_offset(orders, "o_orderdate", 750, 250, "o_orderkey")


# --- schemas ----------------------------------------------------------------------------

SQL_CATALOG = """
declared AS (
  SELECT event_type AS table_name, 'c' || user_id || '_' || CAST(floor(value / 25) AS INTEGER) AS column_name, ts, event_id,
    CASE WHEN value < 20 THEN 'bigint' WHEN value < 60 THEN 'double' ELSE 'string' END AS data_type
  FROM events),
stored AS (
  SELECT table_name, column_name, data_type FROM declared WHERE ts < TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY ts DESC, event_id DESC) = 1),
current AS (
  SELECT table_name, column_name, data_type FROM declared WHERE ts >= TIMESTAMP '2024-01-16'
  QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY ts DESC, event_id DESC) = 1)
"""


def _catalogs(spark, sf):
    """Columns declared in the first and in the second half of the month."""
    value = F.col("value")
    declared = read_table(spark, sf, "events").select(
        F.col("event_type").alias("table_name"),
        F.concat_ws(
            "_", F.concat(F.lit("c"), F.col("user_id").cast("string")), F.floor(value / 25).cast("string")
        ).alias("column_name"),
        F.when(value < 20, "bigint").when(value < 60, "double").otherwise("string").alias("data_type"),
        "ts", "event_id",
    )
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    halves = []
    for half in (declared.filter(F.col("ts") < middle), declared.filter(F.col("ts") >= middle)):
        last = dedup_last_by_key(half, ["table_name", "column_name"], [F.col("ts").desc(), F.col("event_id").desc()])
        halves.append(last.drop("ts", "event_id"))
    return halves


@query(
    f"""WITH {SQL_CATALOG} SELECT c.* FROM current c
    WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.table_name = c.table_name AND s.column_name = c.column_name)"""
)
def schema_diff(spark, sf):
    stored, current = _catalogs(spark, sf)
    return S.schema_diff(current, stored)


@query(
    f"""WITH {SQL_CATALOG}
    SELECT coalesce(s.table_name, c.table_name) AS table_name, coalesce(s.column_name, c.column_name) AS column_name,
      s.data_type AS stored_type, c.data_type AS current_type,
      CASE WHEN s.table_name IS NULL THEN 'added' WHEN c.table_name IS NULL THEN 'dropped' ELSE 'retyped' END AS change
    FROM stored s FULL JOIN current c ON s.table_name = c.table_name AND s.column_name = c.column_name
    WHERE s.data_type IS DISTINCT FROM c.data_type"""
)
def schema_drift(spark, sf):
    return S.schema_drift(*_catalogs(spark, sf))


@query(
    f"""WITH {SQL_CATALOG}
    SELECT 'shop' AS table_schema, c.table_name, c.column_name, c.data_type,
      EXISTS (SELECT 1 FROM stored s WHERE s.table_name = c.table_name AND s.column_name = c.column_name
              AND s.data_type = 'bigint') AS primary_key
    FROM current c"""
)
def pk_discovery(spark, sf):
    """Catalog columns beside the columns of key constraints: here the whole-number ones of before."""
    stored, current = _catalogs(spark, sf)
    keys = stored.filter(F.col("data_type") == "bigint").withColumn("table_schema", F.lit("shop"))
    return S.primary_key_columns(current.withColumn("table_schema", F.lit("shop")), keys)


@query(
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"""
)
def union_by_name(spark, sf):
    supplier = read_table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    customer = read_table(spark, sf, "customer").selectExpr(
        "c_mktsegment segment", "c_acctbal balance", "c_custkey id", "c_name name"
    )
    return S.union_by_name([supplier, customer])


@query(
    """SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS DOUBLE) AS balance, CAST(NULL AS VARCHAR) AS segment
    FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"""
)
def schema_evolve_union(spark, sf):
    """A table of two columns takes rows with four."""
    target = _target(spark, "evolve")
    target.append(read_table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_name name"))
    target.append(
        read_table(spark, sf, "customer").selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    )
    return target.read()


# --- targets and load modes -------------------------------------------------------------


def _run(spark, job, frames, state, root, keys):
    results = run_job(spark, job, FrameSource(frames), root, state, keys)
    failed = [r.error for r in results if r.error]
    if failed:
        raise RuntimeError("; ".join(failed))
    return results


def _job(mode, table="orders", **more):
    return LoadJob.from_config(
        {"id": "shop", "source_type": "postgres", "load_mode": mode, "tables": [table],
         "target_table": f"shop_{_tag()}", **more}
    )


@query(
    f"""WITH {SQL_ORDERS}
    SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM batch"""
)
def load_full_merge(spark, sf):
    """Two full loads: rows the source no longer has remain."""
    root, tag = fresh_dir(spark, "full"), _tag()
    job, state = _job("full"), P.StateStore(spark, root, f"state_{tag}")
    for frame in (order_target(spark, sf), order_batch(spark, sf)):
        _run(spark, job, {"orders": frame}, state, root, {"orders": ("o_orderkey",)})
    return spark.table(job.target_table).select(*order_target(spark, sf).columns)


@query(f"WITH {SQL_ORDERS} SELECT * FROM batch")
def load_ctas(spark, sf):
    """A replacing load leaves nothing of the rows before it."""
    root, tag = fresh_dir(spark, "ctas"), _tag()
    job, state = _job("ctas"), P.StateStore(spark, root, f"state_{tag}")
    for frame in (order_target(spark, sf), order_batch(spark, sf)):
        _run(spark, job, {"orders": frame}, state, root, {"orders": ("o_orderkey",)})
    return spark.table(job.target_table).select(*order_target(spark, sf).columns)


@query("SELECT * FROM orders")
def load_incremental_resume(spark, sf):
    """Three incremental runs, each seeing more of the source, end with all of it."""
    root, tag = fresh_dir(spark, "resume"), _tag()
    job = _job("incremental", options={"snapshot_cursor_column": "o_orderdate"})
    state = P.StateStore(spark, root, f"state_{tag}")
    orders = read_table(spark, sf, "orders")
    for seen in ("1997-01-01", "1999-01-01", "2100-01-01"):
        grown = orders.filter(F.col("o_orderdate") < F.lit(seen).cast("timestamp_ntz"))
        _run(spark, job, {"orders": grown}, state, root, {"orders": ("o_orderkey",)})
    return spark.table(job.target_table).select(*orders.columns)


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS campaign_id, c_mktsegment AS status,
      CASE WHEN c_custkey % 3 = 0 THEN 'New ' || c_name ELSE c_name END AS campaign_name FROM customer"""
)
def job_payload_twice(spark, sf):
    """A configured ads job over pages landed from customers, run again when a third have landed renamed."""
    landing, root, tag = fresh_dir(spark, "pages"), fresh_dir(spark, "ads"), _tag()
    state = P.StateStore(spark, root, f"state_{tag}")
    customer = read_table(spark, sf, "customer")
    renamed = customer.filter("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("New "), "c_name"))
    job = {"id": "ads", "source_type": "google_ads", "connection": {"landing": landing}, "tables": ["campaigns"]}
    for page in (customer, renamed):
        campaign = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
        page.select(campaign.alias("campaign")).write.mode("append").json(f"{landing}/campaigns")
        (result,) = run_configured(spark, {"jobs": [{**job, "target_table": f"ads_{tag}"}]}, root, state)["ads"]
        if result.error:
            raise RuntimeError(result.error)
    return spark.table(f"ads_{tag}").select("campaign_id", "campaign_name", "status")


@query("SELECT 'orders' AS table_name, 'success' AS status, count(*) AS rows FROM orders")
def run_metrics(spark, sf):
    """The run record counts the rows while they are written."""
    root, tag = fresh_dir(spark, "metrics"), _tag()
    job, state = _job("ctas"), P.StateStore(spark, root, f"state_{tag}")
    _run(spark, job, {"orders": read_table(spark, sf, "orders")}, state, root, {})
    return state.runs().select("table_name", "status", "rows")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def insert_no_pk(spark, sf):
    """Without a key the same rows are inserted again."""
    target = _target(spark, "unkeyed")
    for _ in range(2):
        target.append(read_table(spark, sf, "supplier"))
    return target.read()


@query(f"SELECT event_id, user_id, value, {SQL_OP} AS _cdc_op, 'clicks' AS _cdc_source, ts AS _cdc_ts FROM events")
def append_log(spark, sf):
    target = _target(spark, "log")
    events = read_table(spark, sf, "events").select("event_id", "user_id", "value", "event_type", "ts")
    rows = add_cdc_meta(events, "clicks", op=op_of_event(), ts=F.col("ts")).drop("event_type", "ts")
    target.append(rows)
    return target.read().drop("_cdc_ingest_ts")


@query("SELECT *, 'snapshot' AS _cdc_op, 'shop' AS _cdc_source FROM orders")
def ensure_table(spark, sf):
    """A table made from a schema alone, twice, then filled."""
    target = _target(spark, "ensured")
    target.ensure(read_table(spark, sf, "orders").schema)
    target.ensure(read_table(spark, sf, "orders").schema)
    target.append(add_cdc_meta(read_table(spark, sf, "orders"), "shop"))
    return target.read().drop("_cdc_ts", "_cdc_ingest_ts")


@query("SELECT * FROM lineitem")
def sorted_write(spark, sf):
    target = _target(spark, "sorted", sort_by=("l_shipdate", "no_such_column"))
    target.append(read_table(spark, sf, "lineitem"))
    return target.read()


@query(
    """WITH state AS (
      SELECT 'source_' || (user_id % 7) AS source_name, event_type AS source_table, CAST(max(event_id) AS VARCHAR) AS "offset"
      FROM events GROUP BY ALL)
    SELECT * FROM state WHERE NOT (source_name = 'source_3' AND source_table = 'click') AND source_name <> 'source_5'"""
)
def reset_watermark(spark, sf):
    marks = read_table(spark, sf, "events").groupBy(
        F.concat(F.lit("source_"), (F.col("user_id") % 7).cast("string")).alias("source_name"),
        F.col("event_type").alias("source_table"),
    ).agg(F.max("event_id").cast("string").alias("offset"))
    return P.reset_watermark(P.reset_watermark(marks, "source_3", "click"), "source_5")


@query(
    """WITH old AS (
      SELECT user_id AS id, max(event_id) AS value, min(ts) AS created_at, max(ts) AS updated_at
      FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY user_id),
    new AS (
      SELECT user_id AS id, max(event_id) AS value, min(ts) AS created_at, max(ts) AS updated_at
      FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY user_id)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.value, o.value) AS value,
      coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
    FROM old o FULL JOIN new n ON o.id = n.id"""
)
def state_upsert(spark, sf):
    events = read_table(spark, sf, "events")
    middle = F.lit("2024-01-10").cast("timestamp_ntz")
    per_user = lambda df: df.groupBy(F.col("user_id").alias("id")).agg(
        F.max("event_id").alias("value"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )
    old, new = per_user(events.filter(F.col("ts") < middle)), per_user(events.filter(F.col("ts") >= middle))
    return P.state_upsert(old, new, ["id"], created="created_at")


@query(
    """WITH listing AS (SELECT url AS path, max(length(html)) AS length FROM pages GROUP BY url),
    ledger AS (SELECT DISTINCT url AS path FROM pages WHERE html LIKE '%<h1>%' AND length(html) > 2000)
    SELECT * FROM listing WHERE path NOT IN (SELECT path FROM ledger)"""
)
def copy_into_new_files(spark, sf):
    pages = read_table(spark, sf, "pages")
    listing = pages.groupBy(F.col("url").alias("path")).agg(F.max(F.length("html")).cast("bigint").alias("length"))
    big = F.col("html").contains("<h1>") & (F.length("html") > 2000)
    ledger = pages.filter(big).select(F.col("url").alias("path")).distinct()
    return new_files(listing, ledger).select("path", "length")


@query("SELECT * FROM orders")
def copy_into_load(spark, sf):
    """Files arrive in two waves; the second run takes only the new ones, a third none."""
    folder, tag = fresh_dir(spark, "landing"), _tag()
    target, state = _target(spark, "copied"), P.StateStore(spark, folder + "-state", f"state_{tag}")
    orders = read_table(spark, sf, "orders")
    middle = F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz")
    for wave in (orders.filter(middle), orders.filter(~middle), None):
        if wave is not None:
            wave.write.mode("append").parquet(folder)
        copy_into(spark, target, folder, state, pattern=r"\.parquet$")
    return target.read()


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O')")
def copy_files_regex(spark, sf):
    """Files chosen by a pattern on their path below the location."""
    folder, tag = fresh_dir(spark, "regex"), _tag()
    read_table(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(folder)
    target, state = _target(spark, "regex"), P.StateStore(spark, folder + "-state", f"state_{tag}")
    copy_into(spark, target, folder, state, pattern=r"^o_orderstatus=[FO]/")
    return target.read().select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT * FROM orders")
def list_files_since(spark, sf):
    """Rows of the files a listing finds."""
    folder = fresh_dir(spark, "listing")
    read_table(spark, sf, "orders").repartition(parallelism(spark, 6)).write.parquet(folder)
    listing = list_files(spark, folder, newer_than="2020-01-01T00:00:00Z", pattern=r"\.parquet$")
    rows, _ = read_detected(spark, listing)
    return rows.drop("_source_file", "last_modified")


@query("SELECT * FROM orders")
def incremental_files(spark, sf):
    folder = fresh_dir(spark, "mtime")
    read_table(spark, sf, "orders").repartition(parallelism(spark, 4)).write.parquet(folder)
    rows = read_incremental(spark.read.parquet(folder), "2020-01-01T00:00:00Z")
    return rows.drop("_source_file", "last_modified")


@query("SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def clustered_layout(spark, sf):
    rows = read_table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return clustered(rows, ["l_shipdate", "l_orderkey"])


@query(
    f"""WITH {SQL_ORDERS}
    SELECT * FROM target WHERE o_orderkey NOT IN (SELECT o_orderkey FROM batch) UNION ALL SELECT * FROM batch"""
)
def merge_bucketed_target(spark, sf):
    """The same merge into a table bucketed by its key, which is not shuffled."""
    target = _target(spark, "bucketed", keys=("o_orderkey",), buckets=parallelism(spark, 8))
    stamp = lambda df: add_cdc_meta(df, "shop", ts=F.col("o_orderdate"))
    target.replace(stamp(order_target(spark, sf)))
    target.merge(stamp(order_batch(spark, sf)))
    return target.read().select(*order_target(spark, sf).columns)


@query(
    f"""WITH {SQL_ORDERS}, late AS (SELECT * FROM batch WHERE o_orderdate >= TIMESTAMP '2001-01-01')
    SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM late)
    UNION ALL SELECT *, CAST(year(o_orderdate) AS INTEGER) FROM late"""
)
def merge_touched_partitions(spark, sf):
    """A change of recent orders rewrites the recent partitions only."""
    target = _target(spark, "parted", keys=("o_orderkey",), partition_by=("o_year",))
    stamp = lambda df: add_cdc_meta(
        df.withColumn("o_year", F.year("o_orderdate")), "shop", ts=F.col("o_orderdate"), ingest=False
    )
    orders = read_table(spark, sf, "orders")
    target.replace(stamp(orders))
    late = order_batch(spark, sf).filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    target.merge_partitions(stamp(late), M.MergeRules(("o_orderkey",)))
    return target.read().select(*orders.columns, "o_year")


@query(
    f"""WITH {SQL_ORDERS}, late AS (SELECT * FROM batch WHERE o_orderdate >= TIMESTAMP '2001-01-01')
    SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_year FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM late)
    UNION ALL SELECT *, CAST(year(o_orderdate) AS INTEGER) FROM late"""
)
def job_partitioned_merge(spark, sf):
    """Two configured loads into one table partitioned by a part of its key."""
    root, tag = fresh_dir(spark, "parted-job"), _tag()
    orders = read_table(spark, sf, "orders")
    late = order_batch(spark, sf).filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    jobs = []
    for name, rows in (("all", orders), ("late", late)):
        rows.withColumn("o_year", F.year("o_orderdate")).write.parquet(f"{root}/{name}")
        table = {"path": f"{root}/{name}", "primary_key": ["o_orderkey", "o_year"], "partition_by": ["o_year"]}
        jobs.append(
            {"id": name, "source_type": "format", "load_mode": "full", "connection": {"format": "parquet"},
             "tables": ["orders"], "tables_config": {"orders": table}, "target_table": f"parted_{tag}"}
        )
    for (result,) in run_configured(spark, {"jobs": jobs}, root, P.StateStore(spark, root, f"state_{tag}")).values():
        if result.error:
            raise RuntimeError(result.error)
    return spark.table(f"parted_{tag}").select(*orders.columns, "o_year")


@query(
    """SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) AS observed
    FROM orders GROUP BY o_orderpriority"""
)
def observed_counts(spark, sf):
    """Rows are counted on their way to a file, and are the same behind it."""
    path = fresh_dir(spark, "observed")
    rows, metrics = observed(read_table(spark, sf, "orders"))
    rows.write.parquet(path)
    counts = spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.withColumn("observed", F.lit(metrics.get["rows"]).cast("long"))
