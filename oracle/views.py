"""The call-record views of FIXTURES.md written as DuckDB CTEs, plus the
rounding used on both sides of the comparison."""

VOICE = """voice AS (
  SELECT o.o_custkey AS phone_no_m, l.l_partkey AS opposite_no_m,
         CAST(CASE l.l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 WHEN 'N' THEN 3 END AS INTEGER) AS calltype_id,
         l.l_shipdate AS start_datetime, l.l_quantity AS call_dur, n.n_name AS city_name,
         s.s_name AS county_name, l.l_suppkey AS imei_m
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

SMS = """sms AS (
  SELECT user_id AS phone_no_m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS opposite_no_m,
         CAST(CASE WHEN event_type IN ('click', 'purchase') THEN 1
                   WHEN event_type IN ('view', 'signup') THEN 2 ELSE 3 END AS INTEGER) AS calltype_id,
         ts AS request_datetime
  FROM events)"""

APP = """app AS (
  SELECT o.o_custkey AS phone_no_m, p.p_brand AS busi_name, l.l_extendedprice AS flow,
         strftime(o.o_orderdate, '%Y-%m') AS month_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey)"""

USERS = """arpu AS (
  SELECT o_custkey,
         sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS arpu_1,
         sum(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS arpu_2,
         sum(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS arpu_3,
         sum(o_totalprice) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS arpu_4,
         sum(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS arpu_5
  FROM orders GROUP BY o_custkey),
users AS (
  SELECT c.c_custkey AS phone_no_m, n.n_name AS city_name, c.c_mktsegment AS county_name,
         a.arpu_1, a.arpu_2, a.arpu_3, a.arpu_4, a.arpu_5,
         CAST(CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS label,
         CASE WHEN c.c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN arpu a ON a.o_custkey = c.c_custkey)"""

ALL = ",\n".join([VOICE, SMS, APP, USERS])


def with_views(body: str) -> str:
    """Prefix a query body (which may start with more CTEs after a comma)
    with the view CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ALL + ",\n" + body[5:]
    return "WITH " + ALL + "\n" + body


def sig(expr: str, digits: int = 10) -> str:
    """Round a DOUBLE to ``digits`` significant digits, half to even."""
    e = f"CAST(({expr}) AS DOUBLE)"
    scale = f"pow(10, {digits - 1} - floor(log10(abs({e}))))"
    return (f"CASE WHEN {e} IS NULL OR {e} = 0 OR isnan({e}) THEN {e} "
            f"ELSE round_even({e} * {scale}, 0) / {scale} END")


SNAP_DIGITS = 14


def S(expr: str, name: str, digits: int = 10) -> str:
    """Snap to 14 significant digits, then round to ``digits`` (the same
    two steps as ``phonelens.functions.expr.stable``)."""
    return f"{sig(sig(expr, SNAP_DIGITS), digits)} AS {name}"
