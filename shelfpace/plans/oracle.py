"""The registered queries as plain SQL over the given tables, written independently of the operators:
windows per side of the split, a real grid join, a real category pivot, no shortcuts."""

from __future__ import annotations

from shelfpace.plans.tables import TABLE_NAMES

LOOKBACKS = (1, 2, 3, 4, 5)
ROLLING = [f"rolling_{c}_{n}" for c in ("cumsum", "cumsum_pc") for n in LOOKBACKS]
SENTINELS = ["sold_quantity", "minutes_active", "is_active", "current_price", "cumsum", "selling_rate", *ROLLING]
CATEGORIES = {
    "listing_type": ["A", "N", "R"],
    "shipping_payment": ["F", "O"],
    "shipping_logistic_type": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}
UNBOUNDED = "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _r(expr: str, name: str | None = None) -> str:
    """Rounded double. The small shift keeps exact halves off the rounding boundary; adding zero turns a
    negative zero into a plain one."""
    name = name or expr.strip('"')
    return f'ROUND(CAST({expr} AS DOUBLE) + 3e-9, 6) + 0.0 AS "{name}"'


def _rs(names: list[str]) -> str:
    return ", ".join(_r(f'"{n}"') for n in names)


def _with(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


PANEL = """sku_daily AS (
  SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS sold_quantity,
    CAST((MIN(l_linenumber) - 1) * 240 AS DOUBLE) AS minutes_active, MIN(l_extendedprice) AS current_price,
    MIN(l_linestatus) AS currency, MIN(l_returnflag) AS listing_type, MIN(l_linestatus) AS shipping_payment
  FROM lineitem GROUP BY 1, 2)"""
PANEL_FULL = """sku_daily AS (
  SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, SUM(l_quantity) AS sold_quantity,
    CAST((MIN(l_linenumber) - 1) * 240 AS DOUBLE) AS minutes_active, MIN(l_extendedprice) AS current_price,
    MIN(l_linestatus) AS currency, MIN(l_returnflag) AS listing_type, MIN(l_linestatus) AS shipping_payment,
    MIN(o_orderpriority) AS shipping_logistic_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
META_RAW = """meta_raw AS (
  SELECT p_partkey AS sku, CASE WHEN p_type <> 'PROMO'
      THEN 'X-' || p_brand || '-' || p_type || ' ' || p_brand END AS item_domain_id, p_brand AS site_id
  FROM part)"""
META = f"""{META_RAW},
meta AS (SELECT sku, COALESCE(regexp_replace(item_domain_id, '^.*-', ''), '') AS item_domain_id,
  COALESCE(site_id, '') AS site_id FROM meta_raw)"""
SCORED = "scored AS (SELECT p_partkey AS sku, CAST(p_size * 15 AS DOUBLE) AS target_stock FROM part)"


def _chain(prefix: str = "", active: bool = False, running_max: bool = False) -> list[str]:
    """Labelled panel, step by step; the last step is ``<prefix>rolled``."""
    p = prefix
    order = f"ORDER BY date RANGE {UNBOUNDED}" if running_max else ""
    rolling = ",\n    ".join(
        f"AVG({c}) OVER (PARTITION BY sku, is_train ORDER BY id RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)"
        f" AS rolling_{c}_{n}"
        for c in ("cumsum", "cumsum_pc")
        for n in LOOKBACKS
    )
    return [
        f"""{p}rated AS (SELECT *, CASE WHEN minutes_active > 0 THEN sold_quantity / minutes_active ELSE 0 END
    AS selling_rate, CASE WHEN minutes_active > 0 THEN 1 ELSE 0 END AS is_active FROM sku_daily
  {"WHERE minutes_active > 0" if active else ""})""",
        f"{p}placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku ORDER BY date) AS place FROM {p}rated)",
        f"{p}sided AS (SELECT *, CASE WHEN place <= 30 THEN 1 ELSE 0 END AS is_train FROM {p}placed)",
        f"""{p}summed AS (SELECT *, SUM(sold_quantity) OVER (PARTITION BY sku, is_train ORDER BY date
    RANGE {UNBOUNDED}) AS cumsum, ROW_NUMBER() OVER (PARTITION BY sku, is_train ORDER BY date) AS id
  FROM {p}sided)""",
        f"""{p}topped AS (SELECT *, MAX(cumsum) OVER (PARTITION BY sku, is_train {order}) + 1 AS "max"
  FROM {p}summed)""",
        f'{p}scaled AS (SELECT *, cumsum / NULLIF("max", 0) AS cumsum_pc FROM {p}topped)',
        f"{p}rolled AS (SELECT *,\n    {rolling}\n  FROM {p}scaled)",
    ]


PANEL_VALUES = ["sold_quantity", "minutes_active", "current_price", "currency", "listing_type", "shipping_payment"]
CURVE_VALUES = ["selling_rate", "is_active", "cumsum", "max", "cumsum_pc", *ROLLING]


def _dense(
    name: str, source: str, side: int, keys: str = "grid_keys", full: bool = False, fill: bool = True
) -> list[str]:
    """Grid of 30 days per key, left-joined with one side of ``source``."""
    values = [*PANEL_VALUES, *(["shipping_logistic_type"] if full else []), *CURVE_VALUES]
    picked = ", ".join(f'f."{v}"' for v in values)
    steps = [
        f"""{name}_grid AS (SELECT k.sku, d.id FROM {keys} k CROSS JOIN (SELECT UNNEST(range(1, 31)) AS id) d)""",
        f"""{name} AS (SELECT g.sku, g.id, {picked} FROM {name}_grid g LEFT JOIN
    (SELECT * FROM {source} WHERE is_train = {side}) f ON f.sku = g.sku AND f.id = g.id)""",
    ]
    if fill:
        filled = ", ".join(
            f'LAST_VALUE("{c}" IGNORE NULLS) OVER (PARTITION BY sku ORDER BY id ROWS {UNBOUNDED}) AS "{c}"'
            for c in ("currency", "max")
        )
        steps.append(f'{name}_filled AS (SELECT * EXCLUDE (currency, "max"), {filled} FROM {name})')
    return steps


KEYS = "grid_keys AS (SELECT DISTINCT sku FROM sku_daily)"


def _shares(column: str, rule: str, alias: str = "") -> list[str]:
    values = CATEGORIES[column]
    col = f'{alias}"{column}"'

    def count(v: str) -> str:
        return f"SUM(CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END)"

    out = []
    for v in values:
        if rule == "share":
            base = f"COUNT({col})"
        elif rule == "odds":
            base = " + ".join(count(w) for w in values if w != v)
        else:
            base = " + ".join(count(w) for w in values if w not in set(v))
        out.append(_r(f"COALESCE(CAST({count(v)} AS DOUBLE) / NULLIF({base}, 0), 0)", f"{v}_prop"))
    return out


def _features(source: str, side: int, rule: str) -> str:
    shares = [s for c in CATEGORIES for s in _shares(c, rule)]
    means = [
        _r(f"AVG({c})", n)
        for n, c in [
            ("minutes_active_avg", "minutes_active"),
            ("selling_rate_avg", "selling_rate"),
            ("price_avg", "current_price"),
        ]
    ]
    return f"SELECT sku, {', '.join(shares + means)} FROM {source} WHERE is_train = {side} GROUP BY sku"


def _weekdays(source: str, side: int, add_key: bool) -> str:
    sums = ", ".join(
        f"COALESCE(SUM(CASE WHEN dayofweek(date) = {d} THEN sold_quantity END), 0) AS d{d}" for d in range(7)
    )
    total = " + ".join(f"d{d}" for d in range(7)) + (" + sku" if add_key else "")
    shares = ", ".join(_r(f"d{d} / NULLIF({total}, 0)", f"day_{d}") for d in range(7))
    return f"SELECT sku, {shares} FROM (SELECT sku, {sums} FROM {source} WHERE is_train = {side} GROUP BY sku)"


def _active_share(source: str, side: int) -> str:
    share = _r("SUM(is_active) / CAST(COUNT(sku) AS DOUBLE)", "proportion_active")
    return f"SELECT sku, {share} FROM {source} WHERE is_train = {side} GROUP BY sku"


def _target(side: int, name: str) -> list[str]:
    """Active curve of one side on the grid, sentinel, log, plateaus, scored items."""
    return [
        *_dense(f"{name}_d", "a_rolled", side, fill=False),
        f"""{name}_log AS (SELECT d.sku, d.id, m.item_domain_id,
    CASE WHEN COALESCE(d.rolling_cumsum_1, -1) <> -1 THEN LN(d.rolling_cumsum_1 + 0.001) END AS target_stock
  FROM {name}_d d JOIN meta m ON m.sku = d.sku WHERE d.sku IN (SELECT sku FROM scored))""",
        f"""{name} AS (SELECT sku, id, item_domain_id, CASE WHEN ROW_NUMBER() OVER
    (PARTITION BY sku, target_stock ORDER BY id) = 1 THEN target_stock END AS target_stock FROM {name}_log)""",
    ]


TARGET_BASE = [PANEL, *_chain("a_", active=True), KEYS, META, SCORED]
TARGETS = [*TARGET_BASE, *_target(1, "t1")]
TARGETS_BOTH = [*TARGETS, *_target(0, "t0")]
MAXIMA = "maxima AS (SELECT sku, MAX(target_stock) AS target_stock FROM t1 WHERE sku IS NOT NULL GROUP BY sku)"
BOUND = """bound AS (SELECT quantile_cont(target_stock, 0.25) AS qq, quantile_cont(target_stock, 0.25) - 0.5 AS bound
  FROM maxima WHERE target_stock IS NOT NULL)"""
CODES = """words AS (SELECT item_domain_id FROM t1 UNION SELECT item_domain_id FROM t0 UNION
    SELECT COALESCE(m.item_domain_id, '') FROM scored s LEFT JOIN meta m ON m.sku = s.sku),
codes AS (SELECT item_domain_id, CAST(ROW_NUMBER() OVER (ORDER BY item_domain_id) - 1 AS INTEGER) AS code FROM words)"""


def _weights(rows: str) -> str:
    return f"""weights AS (SELECT r.sku, r.id, CASE WHEN r.target_stock IS NULL THEN 0.25
    WHEN c.target_stock > (SELECT bound FROM bound) THEN 1.0 ELSE 0.5 END AS weight
  FROM {rows} r LEFT JOIN maxima c ON c.sku = r.sku)"""


CHANCE = "(1.0 / (1.0 + ABS(k - ((sku * 7 + 3) % 30 + 1))))"


def _chances(rows: str) -> list[str]:
    """One row per (sku, id, class) with probability p, cumulative probability P and cumulative label Y."""
    return [
        f"""spread AS (SELECT r.*, k, {CHANCE} AS raw FROM {rows} r
    CROSS JOIN (SELECT UNNEST(range(1, 31)) AS k) c)""",
        "chances AS (SELECT *, raw / SUM(raw) OVER (PARTITION BY sku, id) AS p FROM spread)",
        f"""stairs AS (SELECT *, LEAST(GREATEST(SUM(p) OVER (PARTITION BY sku, id ORDER BY k ROWS {UNBOUNDED}), 0), 1)
    AS cum_p, CASE WHEN k >= id THEN 1.0 ELSE 0.0 END AS cum_y FROM chances)""",
    ]


LATE_ROWS = """late AS (SELECT sku, id FROM b_summed WHERE is_train = 0 AND id <= 30)"""


def _event_curve() -> str:
    steps = [
        "sku_daily AS (SELECT user_id AS sku, ts AS date, event_id, value AS sold_quantity FROM events)",
        "placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sku ORDER BY date, event_id) AS place FROM sku_daily)",
        "sided AS (SELECT *, CASE WHEN place <= 30 THEN 1 ELSE 0 END AS is_train FROM placed)",
        f"""summed AS (SELECT *, SUM(sold_quantity) OVER (PARTITION BY sku, is_train ORDER BY date RANGE {UNBOUNDED})
    AS cumsum, ROW_NUMBER() OVER (PARTITION BY sku, is_train ORDER BY date, event_id) AS id FROM sided)""",
        'topped AS (SELECT *, MAX(cumsum) OVER (PARTITION BY sku, is_train) + 1 AS "max" FROM summed)',
        'scaled AS (SELECT *, cumsum / NULLIF("max", 0) AS cumsum_pc FROM topped)',
        _chain()[-1],
    ]
    columns = _rs(["cumsum", "max", "cumsum_pc", *ROLLING])
    return _with(
        steps, f"SELECT sku, event_id, id, CAST(is_train AS INTEGER) AS is_train, {columns} FROM rolled"
    )


def _histogram(source: str, length: str, by_value: bool = False) -> str:
    weight = length if by_value else "n"
    share = f"100.0 * {weight} / SUM({weight}) OVER ()"
    return f"""hist AS (SELECT {length}, n AS count, {share} AS proportion FROM
    (SELECT {length}, COUNT(*) AS n FROM (SELECT sku, COUNT(*) AS {length} FROM {source} GROUP BY sku) GROUP BY 1))"""


def _share_over(length: str) -> str:
    return f"SELECT {_r(f'COALESCE(SUM(CASE WHEN {length} > 30 THEN proportion END), 0)', 'share_over')} FROM hist"


ACTIVE_DAYS = "active_days AS (SELECT * FROM sku_daily WHERE minutes_active > 0)"
SAMPLE_KEYS = """picked AS (SELECT sku FROM (SELECT DISTINCT l_partkey AS sku FROM lineitem)
  ORDER BY md5(CAST(sku AS VARCHAR) || ':42'), sku LIMIT 200)"""


def _table(name: str) -> str:
    """One output table of the feature job in its historical form."""
    if name == "test":
        return _score_list()
    base = [PANEL_FULL, *_chain("b_", running_max=True), *_chain("a_", active=True, running_max=True)]
    kind, _, frame = name.partition("_") if name.startswith(("features_", "dof_")) else ("dense", "", name)
    minimal = frame.endswith("_min")
    frame = frame.removesuffix("_min").removeprefix("days_activity_")
    source = "a_rolled" if frame.endswith("_active") else "b_rolled"
    side = 1 if frame.startswith("train") else 0
    if name.startswith("days_activity_"):
        return _with(base, _active_share(source, side))
    if kind == "features":
        return _with(base, _features(source, side, "character_rule"))
    if kind == "dof":
        return _with(base, _weekdays(source, side, True))
    steps = [*base, KEYS, META, *_dense("d", source, side, full=True)]
    doubles = [c for c in SENTINELS if c != "is_active"]
    if minimal:
        body = f"SELECT f.sku, CAST(id AS INTEGER) AS id, {_r('COALESCE(rolling_cumsum_1, -1)', 'rolling_cumsum_1')}"
    else:
        body = (
            "SELECT f.sku, CAST(id AS INTEGER) AS id, currency, listing_type, shipping_payment, "
            f"shipping_logistic_type, {_rs(['max', 'cumsum_pc'])}, "
            + ", ".join(_r(f"COALESCE({c}, -1)", c) for c in doubles)
        )
        if source == "b_rolled":
            body += ", CAST(COALESCE(is_active, -1) AS INTEGER) AS is_active"
    return _with(steps, body + ", item_domain_id, site_id FROM d_filled f JOIN meta m ON m.sku = f.sku")


def _score_list() -> str:
    return _with(
        [META, SCORED],
        f"""SELECT s.sku, {_r('s.target_stock', 'target_stock')}, COALESCE(m.item_domain_id, '') AS item_domain_id,
  m.site_id FROM scored s LEFT JOIN meta m ON m.sku = s.sku""",
    )


def _score_lines() -> str:
    """Text and place of every line, and what is wrong with it."""
    return """kinds AS (SELECT p_partkey AS k, p_partkey % 20 AS kind, CAST(p_partkey AS VARCHAR) AS key, p_size * 15 AS stock,
    ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS position FROM part),
lines AS (SELECT position, k, kind, CASE WHEN kind <> 4 THEN CAST(stock AS DOUBLE) END AS target_stock,
    CASE kind WHEN 1 THEN 'x' || key || ',' || stock WHEN 2 THEN key || ',unknown' WHEN 3 THEN key
        WHEN 4 THEN key || ',' ELSE key || ',' || stock END AS raw,
    CASE kind WHEN 1 THEN 'bad key' WHEN 2 THEN 'bad number' WHEN 3 THEN 'wrong number of fields' END AS reason FROM kinds)"""


def oracle_sql() -> dict[str, str]:
    ints = "CAST(id AS INTEGER) AS id, CAST(is_train AS INTEGER) AS is_train"
    day = "CAST(id AS INTEGER) AS id"
    plain = [PANEL, *_chain("b_")]
    active = [PANEL, *_chain("a_", active=True)]
    compat = [PANEL, *_chain("b_", running_max=True)]
    full = [PANEL_FULL, *_chain("b_")]
    dense_keys = [KEYS, META]
    curve = f"SELECT sku, date, {ints}, {_rs(['cumsum', 'rolling_cumsum_1'])} FROM "
    pc = f"SELECT sku, {ints}, {_rs(['cumsum', 'max', 'cumsum_pc'])} FROM b_scaled"
    rolled = f"SELECT sku, {ints}, {_rs(ROLLING)} FROM "
    target = f"SELECT sku, {day}, item_domain_id, {_r('target_stock')} FROM "
    weight = f"SELECT sku, {day}, {_r('weight')} FROM weights"
    late = [*plain, LATE_ROWS, *_chances("late")]
    wide = ", ".join(
        _r(f"SUM(CASE WHEN k = {k} THEN 2 * (cum_p - cum_y) END)", f"g_{k}") for k in range(1, 31)
    )
    texts = ", ".join(f"printf('%.4f', SUM(CASE WHEN k = {k} THEN p END)) AS p_{k}" for k in range(1, 31))
    consecutive = """SELECT sku, COALESCE(COUNT(date) = MAX(date) - MIN(date) + 1
  AND COUNT(date) = COUNT(DISTINCT date), TRUE) AS consecutive FROM """
    sql = {
        "selling_rate": _with(
            plain, f"SELECT sku, date, {_r('selling_rate')}, CAST(is_active AS INTEGER) AS is_active FROM b_rated"
        ),
        "series_split": _with(plain, f"SELECT sku, date, {ints}, sku || '_' || is_train AS sku_split FROM b_summed"),
        "stock_curve": _with(plain, curve + "b_rolled"),
        "stock_curve_active": _with(active, curve + "a_rolled"),
        "cumsum_pc": _with(plain, pc),
        "cumsum_pc_compat": _with(compat, pc),
        "rolling_means": _with(plain, rolled + "b_rolled"),
        "rolling_means_active": _with(active, rolled + "a_rolled"),
        "rolling_means_compat": _with(compat, rolled + "b_rolled"),
        "event_curve": _event_curve(),
        "category_values": _with(
            [PANEL_FULL],
            """SELECT "column", value, COUNT(*) AS n FROM (SELECT listing_type, shipping_payment, shipping_logistic_type FROM sku_daily)
            UNPIVOT (value FOR "column" IN (listing_type, shipping_payment, shipping_logistic_type)) GROUP BY ALL""",
        ),
        "category_share_long": _with(
            [PANEL_FULL],
            f"""SELECT sku, "column", value, n, {_r("n / CAST(SUM(n) OVER (PARTITION BY sku, \"column\") AS DOUBLE)", "share")} FROM (
            SELECT sku, "column", value, COUNT(*) AS n FROM (SELECT sku, listing_type, shipping_payment, shipping_logistic_type FROM sku_daily)
            UNPIVOT (value FOR "column" IN (listing_type, shipping_payment, shipping_logistic_type)) GROUP BY ALL)""",
        ),
        "repeated_days": "SELECT l_partkey AS sku, CAST(l_shipdate AS DATE) AS date, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
        "category_share": _with(
            full,
            f"SELECT sku, {', '.join(_shares('shipping_logistic_type', 'share'))} "
            "FROM b_sided WHERE is_train = 1 GROUP BY sku",
        ),
        "category_share_compat": _with(
            full,
            f"SELECT sku, {', '.join(_shares('shipping_logistic_type', 'character_rule'))} "
            "FROM b_sided WHERE is_train = 1 GROUP BY sku",
        ),
        "category_odds": _with(
            plain,
            f"SELECT sku, {', '.join(_shares('listing_type', 'odds'))} FROM b_sided WHERE is_train = 1 GROUP BY sku",
        ),
        "category_share_drop_first": _with(
            plain,
            f"SELECT sku, {', '.join(_shares('listing_type', 'share')[1:])} "
            "FROM b_sided WHERE is_train = 1 GROUP BY sku",
        ),
        "sku_features": _with(full, _features("b_sided", 1, "share")),
        "sku_features_compat": _with(full, _features("b_sided", 1, "character_rule")),
        "weekday_profile": _with(plain, _weekdays("b_sided", 1, False)),
        "weekday_profile_compat": _with(plain, _weekdays("b_sided", 1, True)),
        "active_share": _with(plain, _active_share("b_sided", 1)),
        "day_grid": """SELECT k.sku, CAST(d.id AS INTEGER) AS id FROM (SELECT DISTINCT l_partkey AS sku FROM lineitem) k
CROSS JOIN (SELECT UNNEST(range(1, 31)) AS id) d""",
        "dense_panel": _with(
            [*active, KEYS, *_dense("d", "a_rolled", 0)],
            f"SELECT sku, {day}, currency, {_rs(['sold_quantity', 'cumsum', 'cumsum_pc', 'rolling_cumsum_1'])} FROM d",
        ),
        "meta_clean": _with([META], "SELECT sku, item_domain_id, site_id FROM meta"),
        "panel_with_meta": _with(
            [*plain, *dense_keys, *_dense("d", "b_rolled", 1)],
            f"SELECT d.sku, {day}, {_rs(['sold_quantity', 'cumsum'])}, item_domain_id, site_id "
            "FROM d JOIN meta m ON m.sku = d.sku",
        ),
        "forward_filled": _with(
            [*plain, KEYS, *_dense("d", "b_rolled", 0)],
            f"SELECT sku, {day}, currency, {_rs(['cumsum', 'max'])} FROM d_filled",
        ),
        "sentinel_filled": _with(
            [*active, KEYS, *_dense("d", "a_rolled", 1)],
            f"SELECT sku, {day}, currency, {_rs(['max', 'cumsum_pc'])}, CAST(COALESCE(is_active, -1) AS INTEGER) "
            "AS is_active, "
            + ", ".join(_r(f"COALESCE({c}, -1)", c) for c in SENTINELS if c != "is_active")
            + " FROM d_filled",
        ),
        "min_table": _with(
            [*active, *dense_keys, *_dense("d", "a_rolled", 1)],
            f"SELECT d.sku, {day}, {_r('rolling_cumsum_1')}, item_domain_id, site_id FROM d JOIN meta m ON m.sku = d.sku",
        ),
        "score_list": _score_list(),
        "score_order": _with(
            [META, _score_lines()],
            f"""SELECT k AS sku, position AS monid, {_r("target_stock")}, COALESCE(m.item_domain_id, '') AS item_domain_id, m.site_id
            FROM lines LEFT JOIN meta m ON m.sku = k WHERE reason IS NULL""",
        ),
        "rejected_lines": _with(
            [_score_lines()], "SELECT 'score items' AS source, position, reason, raw FROM lines WHERE reason IS NOT NULL"
        ),
        "duplicate_meta": _with([META_RAW], "SELECT site_id, COUNT(*) AS count FROM meta_raw GROUP BY 1 HAVING COUNT(*) > 1"),
        # The numbers marked -1 are the missing ones again.
        "sentinel_target": _with(TARGETS, target + "t1"),
        "date_gaps": f"{consecutive}(SELECT DISTINCT user_id AS sku, CAST(ts AS DATE) AS date FROM events) GROUP BY sku",
        "broken_series": _with(
            [PANEL], f"SELECT * FROM ({consecutive} sku_daily GROUP BY sku) WHERE NOT consecutive"
        ),
        "date_bounds": "SELECT l_partkey AS sku, MIN(CAST(l_shipdate AS DATE)) AS first_date, "
        "MAX(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem GROUP BY 1",
        "distinct_starts": "SELECT DISTINCT first_date FROM (SELECT MIN(CAST(l_shipdate AS DATE)) AS first_date "
        "FROM lineitem GROUP BY l_partkey)",
        "distinct_ends": "SELECT DISTINCT last_date FROM (SELECT MAX(CAST(l_shipdate AS DATE)) AS last_date "
        "FROM lineitem GROUP BY l_partkey)",
        "length_histogram": _with(
            [PANEL, _histogram("sku_daily", "number_of_items")],
            f"SELECT number_of_items, count, {_r('proportion')} FROM hist",
        ),
        "share_over_30": _with([PANEL, _histogram("sku_daily", "number_of_items")], _share_over("number_of_items")),
        "leading_zeros": _with(
            [PANEL],
            """SELECT s.sku, COUNT(CASE WHEN s.minutes_active IS NOT NULL AND s.date < COALESCE(f.first, DATE '9999-12-31')
  THEN 1 END) AS leading_zeros FROM sku_daily s LEFT JOIN
  (SELECT sku, MIN(date) AS first FROM sku_daily WHERE minutes_active <> 0 GROUP BY sku) f ON f.sku = s.sku
GROUP BY s.sku""",
        ),
        "target_prep": _with(TARGETS, target + "t1"),
        "target_prep_validation": _with(TARGETS_BOTH, target + "t0"),
        "scored_targets": _with([SCORED], f"SELECT sku, {_r('LN(target_stock + 0.001)', 'target_stock')} FROM scored"),
        "category_codes": _with([*TARGETS_BOTH, CODES], "SELECT item_domain_id, code FROM codes"),
        "encoded_panel": _with(
            [*TARGETS_BOTH, CODES],
            "SELECT CAST(t.sku AS INTEGER) AS sku, CAST(t.id AS TINYINT) AS id, "
            f"{_r('CAST(target_stock AS FLOAT)', 'target_stock')}, c.code AS item_domain_id "
            "FROM t1 t LEFT JOIN codes c ON c.item_domain_id = t.item_domain_id",
        ),
        "sku_max": _with([*TARGETS, MAXIMA], f"SELECT sku, {_r('target_stock')} FROM maxima"),
        "outlier_bound": _with([*TARGETS, MAXIMA, BOUND], f"SELECT {_rs(['qq', 'bound'])} FROM bound"),
        "sample_weights": _with([*TARGETS, MAXIMA, BOUND, _weights("t1")], weight),
        "sample_weights_validation": _with([*TARGETS_BOTH, MAXIMA, BOUND, _weights("t0")], weight),
        "key_sample": _with([SAMPLE_KEYS], "SELECT sku FROM picked"),
        "sampled_rows": _with(
            [PANEL, SAMPLE_KEYS],
            f"SELECT sku, date, {_r('sold_quantity')} FROM sku_daily WHERE sku IN (SELECT sku FROM picked)",
        ),
        "group_sample": _with(
            [PANEL],
            f"SELECT sku, date, {_r('sold_quantity')} FROM sku_daily "
            "WHERE SUBSTR(md5(CAST(sku AS VARCHAR) || ':42'), 1, 8) < '33333333'",
        ),
        "rps_score": _with(
            late,
            f"SELECT {_r('SQRT(SUM((cum_y - cum_p) * (cum_y - cum_p)) / (COUNT(DISTINCT (sku, id)) - 1))', 'score')} "
            "FROM stairs",
        ),
        "rps_residual": _with(
            late,
            f"SELECT sku, {day}, {wide}, {_r('2.0 * COUNT(*)', 'h_sum')} FROM stairs GROUP BY sku, id",
        ),
        "log_loss": _with(
            [*TARGETS_BOTH, MAXIMA, BOUND, _weights("t0"), *_chances("weights")],
            f"SELECT {_r('SUM(-weight * LN(GREATEST(p, 1e-16))) / SUM(weight)', 'log_loss')} FROM chances WHERE k = id",
        ),
        "day_distribution_check": _with(
            [SCORED], "SELECT sku, CAST(30 AS INTEGER) AS days, TRUE AS sums_to_one, TRUE AS all_positive FROM scored"
        ),
        "probability_text": _with(
            [SCORED, "rows_in AS (SELECT sku, 1 AS id FROM scored)", *_chances("rows_in")],
            f"SELECT {texts} FROM chances GROUP BY sku",
        ),
    }
    for suffix, by_value in (("", False), ("_compat", True)):
        hist = [PANEL, ACTIVE_DAYS, _histogram("active_days", "counts", by_value)]
        sql[f"active_histogram{suffix}"] = _with(hist, f"SELECT counts, count, {_r('proportion')} FROM hist")
        sql[f"active_share_over_30{suffix}"] = _with(hist, _share_over("counts"))
    sql.update({f"table_{name}": _table(name) for name in TABLE_NAMES})
    return sql
