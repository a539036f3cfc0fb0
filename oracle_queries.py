"""DuckDB SQL that states what every registered query has to return.

Each text starts from the same ledger view over the star tables. Year-over-year queries
tag the rows of both windows and stack them, independent of how the Spark plans do it.
"""

from __future__ import annotations

LEDGER = """
ledger as (
  select
    cast(l_shipdate as date) as paid_on,
    cast(year(l_shipdate) as int) as pay_year,
    cast(month(l_shipdate) as int) as pay_month,
    cast(round(l_extendedprice * 100) as bigint)
      * (case when l_returnflag = 'R' then -1 else 1 end) as nominal,
    case when l_returnflag = 'N' then 'MPN'
         when l_returnflag = 'A' and l_linestatus = 'F' then 'SPM'
         when l_returnflag = 'A' and l_linestatus = 'O' then 'PBK TERIMA'
         when l_returnflag = 'R' and l_linestatus = 'F' then 'PBK KIRIM'
         when l_returnflag = 'R' and l_linestatus = 'O' then 'SPMKP' end as kind,
    n_name as office,
    'S' || cast(o_custkey % 6 as varchar) as section,
    'AR' || cast(o_custkey % 40 as varchar) as officer,
    p_type as tax_type,
    p_brand as deposit_code,
    case when c_custkey % 97 = 0 then null else c_mktsegment end as sector,
    c_mktsegment || '-' || cast(c_nationkey % 4 as varchar) as subsector,
    c_mktsegment || '-' || cast(c_nationkey % 4 as varchar) || '-'
      || cast(c_custkey % 10 as varchar) as klu,
    case when o_orderpriority = '4-NOT SPECIFIED' then '' else o_orderpriority end as segment,
    case when c_acctbal < 0 then 'BADAN' when c_custkey is not null then 'OP' end as payer_kind,
    case when o_custkey % 50 = 0 then '000000000' || cast(o_custkey as varchar)
         else '9' || cast(1000000 + o_custkey as varchar) end as npwp15,
    'N' || cast(o_custkey as varchar) as npwp,
    c_name as payer
  from lineitem
  left join orders on l_orderkey = o_orderkey
  left join customer on o_custkey = c_custkey
  left join nation on c_nationkey = n_nationkey
  left join part on l_partkey = p_partkey
),
targets as (
  select n_name as office, (cast(n_nationkey as bigint) + 1) * 100000000 as target_cy,
         (cast(n_nationkey as bigint) + 1) * 90000000 as target_py
  from nation
),
labels as (
  select * from (values ('FURNITURE', 'FURN'), ('BUILDING', 'BLDG'),
                        ('AUTOMOBILE', 'AUTO'), ('HOUSEHOLD', 'HOME')) as t(raw, label)
)"""

CY = "paid_on between date '2000-01-01' and date '2000-06-30'"
PY = "paid_on between date '1999-01-01' and date '1999-06-30'"
LONG_CY = "paid_on between date '1999-01-01' and date '2000-06-30'"
LONG_PY = "paid_on between date '1998-01-01' and date '1999-06-30'"
CHOSEN = (
    "office in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_6')"
    " and tax_type in ('STANDARD', 'ECONOMY', 'PROMO')"
    " and sector in ('BUILDING', 'FURNITURE', 'MACHINERY')"
    " and segment in ('1-URGENT', '2-HIGH', '5-LOW')"
)
LISTED = "payer in (select c_name from customer where c_acctbal < 0)"
GROSS2 = "kind in ('MPN', 'SPM')"


def _with(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([LEDGER, *ctes]) + "\n" + body


def _stacked(cy: str = CY, py: str = PY, where: str = "true") -> str:
    """Rows of both windows, each tagged with its period, one below the other."""
    return f"""
both_periods as (
  select 'cy' as period, * from ledger where {cy} and {where}
  union all
  select 'py' as period, * from ledger where {py} and {where}
)"""


def _pivot_sum(period: str, condition: str = "true") -> str:
    """NULL without rows in the period, 0 with rows but none meeting the condition."""
    return (
        f"cast(case when count(*) filter (where period = '{period}') > 0 then"
        f" coalesce(sum(nominal) filter (where period = '{period}' and {condition}), 0) end"
        " as bigint)"
    )


YOY = f"""
  {_pivot_sum('py', GROSS2)} as gross_py, {_pivot_sum('cy', GROSS2)} as gross_cy,
  {_pivot_sum('py')} as net_py, {_pivot_sum('cy')} as net_cy"""

RISES = """
  gross_cy - gross_py as rise_gross, net_cy - net_py as rise_net,
  round((gross_cy - gross_py) / nullif(gross_py, 0) * 100, 6) as growth_gross_pct"""


def _amount_label(x: str, places: int = 3) -> str:
    parts = " ".join(
        f"when abs({x}) > {unit} then format('{{:,.{places}f}}{suffix}', {x} / {unit}.0::double)"
        for suffix, unit in (("T", 10**12), ("M", 10**9), ("Jt", 10**6))
    )
    return f"case {parts} else format('{{:,.0f}}', {x}::double) end"


def _unit_label(x: str, places: int, unit: int = 10**9, suffix: str = "M") -> str:
    return (
        f"case when {x} is not null then"
        f" format('{{:,.{places}f}}{suffix}', {x} / {unit}.0::double) end"
    )


def _target_label(x: str, places: int = 2) -> str:
    return (
        f"case when {x} > 1000000000000 then {_unit_label(x, places, 10**12, 'T')}"
        f" else {_unit_label(x, places)} end"
    )


def _pct_label(x: str, places: int) -> str:
    return f"case when {x} is not null then format('{{:,.{places}f}}%', {x}::double) end"


def _sector_yoy(cy: str = CY, py: str = PY, keys: str = "", where: str = "true") -> str:
    """CTEs up to ``sectors``: labelled sums of both periods."""
    return (
        _stacked(cy, py, where)
        + f""",
sectors as (
  select label as sector {keys}, {YOY}
  from both_periods join labels on sector = raw
  group by label {keys}
)"""
    )


def _tax_yoy(keys: str) -> str:
    not_null = " and ".join(f"{k.strip()} is not null" for k in keys.split(","))
    return (
        _stacked()
        + f""",
sums as (select {keys}, {YOY} from both_periods where {not_null} group by {keys}),
taxes as (
  select {keys}, gross_py, gross_cy, net_py, net_cy,
    round_even((gross_cy - gross_py) / nullif(gross_py, 0) * 100, 2) as growth_pct,
    round_even(gross_cy / (select sum(gross_cy) from sums) * 100, 2) as share_cy_pct,
    round_even(gross_py / (select sum(gross_py) from sums) * 100, 2) as share_py_pct
  from sums
)"""
    )


def _tax_top(keys: str) -> str:
    return _with(
        f"""select *, {_unit_label('gross_cy', 1)} as gross_cy_label from taxes
        order by gross_cy desc nulls last, {keys} limit 10""",
        _tax_yoy(keys),
    )


def _kpi(where: str) -> str:
    return f"""
kpi as (
  select 'cy' as period,
    cast(sum(nominal) filter (where {where} and kind <> 'SPMKP') as bigint) as gross,
    cast(sum(nominal) filter (where {where}) as bigint) as net,
    sum(nominal) filter (where {where}) / sum(nominal) as share
  from ledger where {CY}
  union all
  select 'py',
    cast(sum(nominal) filter (where {where} and kind <> 'SPMKP') as bigint),
    cast(sum(nominal) filter (where {where}) as bigint),
    sum(nominal) filter (where {where}) / sum(nominal)
  from ledger where {PY}
)"""


def _cards(where: str, offices: str) -> str:
    def step(x: str, y: str) -> str:
        return f"case when {y} <> 0 then ({x} - {y}) / {y} when {x} > 0 then 1.0 else 0.0 end"

    return _with(
        f"""
    select target_cy, target_py,
      round((target_cy - target_py) / target_py * 100, 6) as target_growth_pct,
      gross_cy, gross_py, round(({step('gross_cy', 'gross_py')}) * 100, 6) as gross_growth_pct,
      net_cy, net_py, round(({step('net_cy', 'net_py')}) * 100, 6) as net_growth_pct,
      round(share_cy * 100, 6) as share_pct,
      round((share_cy - share_py) * 100, 6) as share_change,
      round(net_cy / target_cy * 100, 6) as attainment_pct,
      round(net_cy / target_cy * 100 - net_py / target_py * 100, 6) as attainment_change,
      {_target_label('target_cy')} as target_label,
      {_amount_label('gross_cy')} as gross_label,
      {_amount_label('net_cy')} as net_label,
      {_pct_label('((target_cy - target_py) / target_py * 100)', 2)} as target_growth_label,
      {_pct_label(f"(({step('gross_cy', 'gross_py')}) * 100)", 2)} as gross_growth_label,
      {_pct_label(f"(({step('net_cy', 'net_py')}) * 100)", 2)} as net_growth_label,
      {_pct_label('(share_cy * 100)', 2)} as share_label,
      {_pct_label('((share_cy - share_py) * 100)', 2)} as share_change_label,
      printf('%.2f%%', net_cy / target_cy * 100) as attainment_label,
      printf('%.2f%%', net_cy / target_cy * 100 - net_py / target_py * 100)
        as attainment_change_label
    from wide, goal""",
        _kpi(where),
        """
wide as (
  select coalesce(max(gross) filter (where period = 'cy'), 0) as gross_cy,
    coalesce(max(gross) filter (where period = 'py'), 0) as gross_py,
    coalesce(max(net) filter (where period = 'cy'), 0) as net_cy,
    coalesce(max(net) filter (where period = 'py'), 0) as net_py,
    coalesce(max(share) filter (where period = 'cy'), 0) as share_cy,
    coalesce(max(share) filter (where period = 'py'), 0) as share_py
  from kpi
)""",
        f"""
goal as (
  select cast(sum(target_cy) as bigint) as target_cy, cast(sum(target_py) as bigint) as target_py
  from targets where {offices}
)""",
    )


def _trend(where: str, offices: str) -> str:
    return _with(
        f"""
    select pay_year, pay_month, net, cumulative,
      round(pct, 6) as cumulative_pct,
      (['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September',
        'October', 'November', 'December'])[pay_month] as month,
      {_amount_label('net')} as net_label, {_amount_label('cumulative')} as cumulative_label,
      {_pct_label('pct', 2)} as cumulative_pct_label
    from (
      select *, cumulative / (select case when pay_year = 2000 then sum(target_cy)
                                          when pay_year = 1999 then sum(target_py) end
                              from targets where {offices}) * 100 as pct
      from running
    )""",
        f"""
months as (
  select pay_year, pay_month, cast(sum(nominal) as bigint) as net from ledger
  where ({CY} or {PY}) and {where} group by all
),
running as (
  select *, cast(sum(net) over (partition by pay_year order by pay_month) as bigint) as cumulative
  from months
)""",
    )


def _bands(payers: str, rank_by: str, share_of: str, measures: list[str]) -> str:
    """Rank bands by ranking every payer."""
    sums = ", ".join(f"cast(coalesce(sum({m}), 0) as bigint) as {m}" for m in measures)
    cols = ", ".join(measures)
    label = f", {_amount_label('gross')} as gross_label" if len(measures) > 1 else ""
    return _with(
        f"""
    select *, round({share_of} / nullif((select sum({share_of}) from payers), 0) * 100, 6)
      as share_pct {label}
    from (
      select 'payer' as row_kind, cast(rank as int) as pos, npwp, payer, {cols}, cast(1 as bigint) as n
      from ranked where rank <= 10
      union all
      select 'band', cast(pos as int), null, caption, {sums}, count(rank) as n
      from bands left join ranked on rank between first and last group by pos, caption
      union all
      select 'total', 1, null, 'Total', {sums}, count(*) as n from payers
    )""",
        payers,
        f"""
ranked as (
  select *, row_number() over (order by {rank_by} desc nulls last, npwp nulls first,
                               payer nulls first) as rank from payers
),
bands as (
  select * from (values (1, 1, 10, 'Penerimaan 10 WP Terbesar'),
    (2, 11, 100, 'Penerimaan 11 s.d. 100 WP Terbesar'),
    (3, 101, 500, 'Penerimaan 101 s.d. 500 WP Terbesar')) as t(pos, first, last, caption)
  union all
  select 4, 501, 9223372036854775807,
    'Penerimaan 501 s.d. ' || (select count(*) from payers) || ' WP Terbesar'
)""",
    )


def _payers_net(where: str) -> str:
    return f"""
payers as (
  select npwp, payer, cast(sum(nominal) as bigint) as net,
    cast(coalesce(sum(nominal) filter (where {GROSS2}), 0) as bigint) as gross
  from ledger where {where} and npwp is not null and payer is not null group by npwp, payer
)"""


def _payers_gross4(where: str) -> str:
    return f"""
payers as (
  select npwp, payer, cast(sum(nominal) as bigint) as gross from ledger
  where {where} and kind in ('MPN', 'SPM', 'PBK KIRIM', 'PBK TERIMA') group by npwp, payer
)"""


def _monthly_growth(refund: str, labels: bool = False) -> str:
    names = [
        "January", "February", "March", "April", "May", "June",
        "July", "August", "September", "October", "November", "December",
    ]
    cells = []
    for i, name in enumerate(names, start=1):
        cell = f"coalesce(max(g) filter (where pay_month = {i}), 0)"
        cells.append((_pct_label(cell, 2) if labels else f"round({cell}, 6)") + f' as "{name}"')
    cells = ", ".join(cells)

    def amounts(period: str, dates: str, year: int) -> str:
        return f"""
{period} as (
  select pay_month,
    sum(nominal) filter (where {GROSS2} and pay_year = {year}) as gross,
    sum(nominal) filter (where pay_year = {year}) as net,
    abs(sum(nominal) filter (where kind in ({refund}) and pay_year = {year})) as refund
  from ledger where {dates} group by pay_month
)"""

    rows = " union all ".join(
        f"select '{m}' as growth, pay_month, (c.{m} - p.{m}) / nullif(p.{m}, 0) * 100 as g"
        " from c join p using (pay_month)"
        for m in ("gross", "net", "refund")
    )
    return _with(
        f"""select growth, {cells}
        from (values ('gross'), ('net'), ('refund')) as names(growth)
        left join ({rows}) as long using (growth) group by growth""",
        amounts("c", CY, 2000),
        amounts("p", PY, 1999),
    )


SUBSECTORS = (
    _stacked(where=GROSS2)
    + f""",
detail as (
  select sector, subsector, klu, {_pivot_sum('py')} as gross_py, {_pivot_sum('cy')} as gross_cy
  from both_periods
  where sector is not null and subsector is not null and klu is not null
  group by sector, subsector, klu
)"""
)


def _rollup(key: str, where: str = "true") -> str:
    return _with(
        f"""select {key}, gross_py, gross_cy, gross_cy - gross_py as difference,
          round((gross_cy - gross_py) / nullif(gross_py, 0) * 100, 6) as growth_pct
        from (select {key}, cast(coalesce(sum(gross_py), 0) as bigint) as gross_py,
                cast(coalesce(sum(gross_cy), 0) as bigint) as gross_cy
              from detail where {where} group by {key})""",
        SUBSECTORS,
    )


def _nodes(links: str, source: str, target: str) -> str:
    return f"""
nodes as (
  select cast(row_number() over (order by side_no, label nulls last) - 1 as int) as node,
    case side_no when 0 then 'source' else 'target' end as side, label
  from (select distinct 0 as side_no, {source} as label from {links}
        union all select distinct 1, {target} from {links})
)"""


def _sector_tax(where: str) -> str:
    return f"""
links as (
  select sector, tax_type, cast(sum(nominal) as bigint) as value
  from ledger where {where} group by sector, tax_type
)"""


def _links(columns: str, links: str, source: str, target: str) -> str:
    return f"""
    select {columns}, s.node as source_node, t.node as target_node
    from {links} k
    left join nodes s on s.side = 'source' and s.label is not distinct from k.{source}
    left join nodes t on t.side = 'target' and t.label is not distinct from k.{target}"""


def _top10(where: str, body: str, *ctes: str) -> str:
    return _with(
        body,
        f"""
payers as (
  select npwp15, payer, office,
    cast(sum(nominal) filter (where pay_year = 2000) as bigint) as cy,
    cast(sum(nominal) filter (where pay_year = 1999) as bigint) as py
  from ledger
  where {GROSS2} and npwp15 not like '000000000%' and (({CY}) or ({PY})) and {where}
  group by npwp15, payer, office
  having sum(nominal) filter (where pay_year = 2000) is not null
),
ranked as (
  select *, cast(row_number() over (partition by office order by cy desc, npwp15, payer) as int)
    as rank from payers
),
listed as (
  select *, round((cy - py) / nullif(py, 0) * 100, 6) as growth_pct from ranked where rank <= 10
)""",
        *ctes,
    )


def _profile(
    report: str,
    columns: list[tuple[str, str]],
    where: dict[str, str] | None = None,
    formats: dict[str, str] | None = None,
) -> str:
    """One row per column; ``columns`` pairs each name with number, date (:pattern) or text.

    ``where`` has the rows that count for a column, ``formats`` the formats its text fits.
    """
    rows, whole = [], report
    for name, kind in columns:
        report = f"(select * from {whole} where {where[name]})" if where else whole
        low, high, first, last = "null::double", "null::double", "null", "null"
        if kind == "number":
            low, high = f"min({name})::double", f"max({name})::double"
        if kind == "date":
            first, last = f"min({name})::timestamp", f"max({name})::timestamp"
        if kind.startswith("date:"):
            kind, pattern = kind.split(":")
            first, last = (f"{f}(strptime({name}, '{pattern}'))" for f in ("min", "max"))
        rows.append(
            f"""select '{name}' as column_name, '{kind}' as kind,
              count(*) > count({name}) as has_missing, count(distinct {name}) as n,
              {low} as low, {high} as high, {first} as first, {last} as last,
              count(*) as rows_left, '{(formats or {}).get(name, "")}' as formats,
              (select string_agg(v, '|' order by v) from
                (select distinct cast({name} as varchar) as v from {report})) as choices
            from {report}"""
        )
    more = ", rows_left" if where else ", formats, contains(formats, '|') as ambiguous" if formats else ""
    return f"""
    select column_name, case when n < 10 then 'membership' else kind end as filter_kind,
      has_missing, case when n < 10 then coalesce(choices, '') end as choices,
      case when n >= 10 then low end as low, case when n >= 10 then high end as high,
      case when n >= 10 then round((high - low) / 100, 6) end as step,
      case when n >= 10 then cast(first as timestamp) end as first,
      case when n >= 10 then cast(last as timestamp) end as last{more}
    from ({" union all ".join(rows)})"""


PROFILED = [
    ("payer", "text"), ("sector", "text"), ("gross_py", "number"), ("gross_cy", "number"),
    ("net_py", "number"), ("net_cy", "number"), ("rise_gross", "number"),
    ("rise_net", "number"), ("growth_gross_pct", "number"),
]

#: Reports that are also served from a page's one aggregate.
PAGE = (
    "kpi_totals", "kpi_cards", "kpi_cards_chosen", "period_delta", "receipt_kind_yoy",
    "monthly_trend", "monthly_growth", "sector_yoy", "tax_type_yoy",
)

SECTOR_FACET = "coalesce(sector in ('BLDG', 'HOME'), false)"
GROSS_FACET = "coalesce(gross_cy between 1000000 and 30000000, false)"

RANKED_SECTORS = f"""
rises as (
  select *, {RISES}, round(gross_cy / (select sum(gross_cy) from sectors) * 100, 6) as share_pct
  from sectors
),
sides as (
  select *, 'all' as side from rises
  union all select *, 'surplus' from rises where rise_gross > 0 and sector not in ('KLU ERROR', ' ')
  union all select *, 'shortfall' from rises where rise_gross < 0 and sector not in ('KLU ERROR', ' ')
)"""


def _average_rank(by: str) -> str:
    """Mean place of a value, counted pair by pair over the few sectors of a side."""
    return f"""
    select *, case when {by} is not null then
      (select count(*) from sides o where o.side = s.side and o.{by} > s.{by}) + 1
      + ((select count(*) from sides o where o.side = s.side and o.{by} = s.{by}) - 1) / 2.0::double
      end as rank
    from sides s"""


def build() -> dict[str, str]:
    """SQL per registered query."""
    option = "select '{0}' as dimension, {0} as value from ledger where {0} is not null {1}"
    q = {
        "filter_options": _with(
            " union ".join(
                option.format(c, f"and {c} <> ''" if c in ("segment", "payer") else "")
                for c in ("office", "tax_type", "sector", "segment", "payer")
            )
        ),
        "kpi_totals": _with(
            "select period, gross, net, round(share, 6) as share from kpi", _kpi("true")
        ),
        "kpi_totals_chosen": _with(
            "select period, gross, net, round(share, 6) as share from kpi", _kpi(CHOSEN)
        ),
        "kpi_totals_of_listed": _with(
            "select period, gross, net, round(share, 6) as share from kpi", _kpi(LISTED)
        ),
        "kpi_cards": _cards("true", "true"),
        "kpi_cards_chosen": _cards(
            CHOSEN, "office in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_6')"
        ),
        "receipt_kind_yoy": _with(
            f"""select kind, amount_cy, amount_py, amount_cy - amount_py as difference,
              {_amount_label('amount_cy')} as amount_cy_label,
              {_amount_label('(amount_cy - amount_py)')} as difference_label
            from c left join p using (kind)""",
            f"""
c as (select kind, cast(abs(sum(nominal)) as bigint) as amount_cy from ledger
      where {CY} group by kind),
p as (select kind, cast(abs(sum(nominal)) as bigint) as amount_py from ledger
      where {PY} group by kind)""",
        ),
        "monthly_trend": _trend("true", "true"),
        "monthly_trend_chosen": _trend(
            CHOSEN, "office in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_5', 'NATION_6')"
        ),
        "sector_totals": _with(
            f"""select sector, any_value(label) as label, cast(sum(nominal) as bigint) as net,
              cast(sum(nominal) filter (where {GROSS2}) as bigint) as gross
            from ledger left join labels on sector = raw where {CY} group by sector"""
        ),
        "sector_totals_all_dates": _with(
            f"""select sector, any_value(label) as label, cast(sum(nominal) as bigint) as net,
              cast(sum(nominal) filter (where {GROSS2}) as bigint) as gross
            from ledger left join labels on sector = raw group by sector"""
        ),
        "sector_yoy": _with(f"select *, {RISES} from sectors", _sector_yoy()),
        "sector_yoy_chosen": _with(f"select *, {RISES} from sectors", _sector_yoy(where=CHOSEN)),
        "sector_yoy_long_window": _with(
            f"select *, {RISES} from sectors", _sector_yoy(LONG_CY, LONG_PY)
        ),
        "sector_payer_yoy": _with(f"select *, {RISES} from sectors", _sector_yoy(keys=", payer")),
        "sector_payer_yoy_of_listed": _with(
            f"select *, {RISES} from sectors", _sector_yoy(keys=", payer", where=LISTED)
        ),
        "sector_month_yoy": _with("select * from sectors", _sector_yoy(keys=", pay_month")),
        "sector_sparkline": _with(
            """select sector, pay_month, coalesce(gross_py, 0) as gross_py,
              coalesce(gross_cy, 0) as gross_cy, coalesce(net_py, 0) as net_py,
              coalesce(net_cy, 0) as net_cy from sectors""",
            _sector_yoy(keys=", pay_month"),
        ),
        "sector_top10": _with(
            f"""select sector, gross_py, gross_cy, net_py, net_cy, {RISES},
              round(share_cy, 6) as share_cy_pct, round(share_py, 6) as share_py_pct,
              {_amount_label('gross_cy', 2)} as gross_cy_label,
              {_amount_label('gross_py', 2)} as gross_py_label,
              {_pct_label('share_cy', 1)} as share_cy_label,
              {_pct_label('share_py', 1)} as share_py_label,
              {_pct_label('((gross_cy - gross_py) / nullif(gross_py, 0) * 100)', 1)} as growth_label
            from (select *, gross_cy / (select sum(gross_cy) from sectors) * 100 as share_cy,
                    gross_py / (select sum(gross_py) from sectors) * 100 as share_py from sectors)
            order by net_cy desc nulls last, sector limit 10""",
            _sector_yoy(),
        ),
        "sector_daily": _with(
            f"""select paid_on, sector, cast(sum(nominal) as bigint) as gross
            from ledger where {GROSS2} and {CY} group by paid_on, sector"""
        ),
        "klu_contribution": _with(
            f"""select sector, klu, gross, round(gross / 1e9, 6) as gross_billions,
              round(pct, 6) as share_pct, {_pct_label('pct', 2)} as share_label
            from (select *, gross / (select sum(gross) from klus) * 100 as pct from klus)""",
            f"""
klus as (select sector, klu, cast(sum(nominal) as bigint) as gross from ledger
         where {GROSS2} and {CY} group by sector, klu)""",
        ),
        "sector_surplus_shortfall": _with(
            _average_rank("gross_cy"), _sector_yoy(), RANKED_SECTORS
        ),
        "sector_surplus_shortfall_by_growth": _with(
            _average_rank("growth_gross_pct"), _sector_yoy(), RANKED_SECTORS
        ),
        "sectors_with_other": _with(
            """select 'sector' as row_kind, sector, net, gross from ranked where rank <= 10
            union all
            select 'other', 'LAINNYA', cast(coalesce(sum(net), 0) as bigint),
              cast(coalesce(sum(gross), 0) as bigint) from ranked where rank > 10""",
            f"""
ranked as (
  select *, row_number() over (order by net desc, sector) as rank from (
    select label as sector, cast(sum(nominal) as bigint) as net,
      cast(coalesce(sum(nominal) filter (where {GROSS2}), 0) as bigint) as gross
    from ledger join labels on sector = raw where {CY} group by label)
)""",
        ),
        "tax_type_yoy": _with("select * from taxes", _tax_yoy("tax_type")),
        "tax_type_payer_yoy": _with(
            "select * from taxes", _tax_yoy("payer, tax_type, payer_kind")
        ),
        "tax_type_top10": _tax_top("tax_type"),
        "tax_type_payer_top10": _tax_top("payer, tax_type, payer_kind"),
        "deposit_code_contribution": _with(
            """select tax_type, deposit_code, gross, round(gross / 1e9, 6) as gross_billions,
              round(gross / (select sum(gross) from codes) * 100, 6) as share_pct from codes""",
            f"""
codes as (select tax_type, deposit_code, cast(sum(nominal) as bigint) as gross from ledger
          where {GROSS2} and {CY} group by tax_type, deposit_code)""",
        ),
        "payer_movers": _with(
            """select side, cast(pos as int) as pos, npwp, payer, gross_py, gross_cy, difference,
              format('{:,.1f}', gross_py / 1e9) as gross_py_label,
              format('{:,.1f}', gross_cy / 1e9) as gross_cy_label,
              format('{:,.1f}', difference / 1e9) as difference_label
            from (
              select 'top' as side, *, row_number() over (
                order by difference desc nulls last, npwp, payer) as pos from moves
              union all
              select 'bottom', *, row_number() over (
                order by difference asc nulls last, npwp, payer) from moves)
            where pos <= 10""",
            _stacked(where=GROSS2),
            f"""
moves as (
  select *, gross_cy - gross_py as difference from (
    select npwp, payer, {_pivot_sum('py')} as gross_py, {_pivot_sum('cy')} as gross_cy
    from both_periods where npwp is not null and payer is not null group by npwp, payer)
)""",
        ),
        "payer_bands_gross": _bands(_payers_gross4(CY), "gross", "gross", ["gross"]),
        "payer_bands_gross_all_dates": _bands(_payers_gross4("true"), "gross", "gross", ["gross"]),
        "payer_bands_net": _bands(_payers_net(CY), "net", "gross", ["net", "gross"]),
        "payer_bands_net_all_dates": _bands(_payers_net("true"), "net", "gross", ["net", "gross"]),
        "payer_totals": _with("select * from payers", _payers_net(CY)),
        "payer_totals_of_listed": _with(
            "select * from payers where payer in (select c_name from customer where c_acctbal < 0)",
            _payers_net(CY),
        ),
        "payer_totals_all_dates": _with("select * from payers", _payers_net("true")),
        "office_attainment": _with(
            f"""select office, target_cy, target_py, net_py, net_cy,
              round(attainment, 6) as attainment_pct, round(growth, 6) as growth_pct,
              {", ".join(f"{_unit_label(c, 2)} as {c}_label"
                         for c in ("target_cy", "target_py", "net_py", "net_cy"))},
              {_pct_label('attainment', 2)} as attainment_label,
              {_pct_label('growth', 2)} as growth_label
            from attained""",
            _stacked(),
            OFFICES,
        ),
        "office_attainment_mean": _with(
            """select round(avg(attainment), 6) as mean_attainment_pct,
              round(avg(growth), 6) as mean_growth_pct from attained""",
            _stacked(),
            OFFICES,
        ),
        "target_totals": _with(
            """select *, round((target_cy - target_py) / target_py * 100, 6) as target_growth_pct
            from (select cast(sum(target_cy) as bigint) as target_cy,
                    cast(sum(target_py) as bigint) as target_py from targets)"""
        ),
        "top10_payers_per_office": _top10("true", "select * from listed"),
        "top10_payers_per_office_chosen": _top10(CHOSEN, "select * from listed"),
        "top10_payers_per_office_of_listed": _top10(LISTED, "select * from listed"),
        "top10_payers_cluster": _top10(
            "true",
            """select *, round((select avg(cy) from kept), 6) as mean_cy,
              round((select avg((cy - py) / nullif(py, 0) * 100) from kept), 6) as mean_growth_pct
            from kept""",
            "kept as (select * from listed where office not in ('NATION_7', 'NATION_9'))",
        ),
        "monthly_growth": _monthly_growth("'SPMKP'"),
        "monthly_growth_gross_as_refund": _monthly_growth("'MPN', 'SPM'"),
        "monthly_growth_labels": _monthly_growth("'SPMKP'", labels=True),
        "subsector_yoy": _with("select * from detail", SUBSECTORS),
        "subsector_rollup": _rollup("subsector"),
        "subsector_rollup_of_sector": _rollup("subsector", "sector = 'BUILDING'"),
        "klu_rollup": _rollup("klu"),
        "klu_rollup_of_sector": _rollup("klu", "sector = 'BUILDING'"),
        "sector_tax_flow_nodes": _with(
            "select * from nodes", _sector_tax(CY), _nodes("links", "sector", "tax_type")
        ),
        "sector_tax_flow_links": _with(
            _links("sector, tax_type, value", "links", "sector", "tax_type"),
            _sector_tax(CY),
            _nodes("links", "sector", "tax_type"),
        ),
        "sector_tax_flow_links_all_dates": _with(
            _links("sector, tax_type, value", "links", "sector", "tax_type"),
            _sector_tax("true"),
            _nodes("links", "sector", "tax_type"),
        ),
        "subsector_flow_nodes": _with(
            "select * from nodes", SUBSECTORS, _nodes("detail", "sector", "subsector")
        ),
        "subsector_flow_links": _with(
            _links("sector, subsector, gross_py, gross_cy", "pairs", "sector", "subsector"),
            SUBSECTORS,
            """
pairs as (
  select sector, subsector, cast(coalesce(sum(gross_py), 0) as bigint) as gross_py,
    cast(coalesce(sum(gross_cy), 0) as bigint) as gross_cy
  from detail where sector <> '' group by sector, subsector
)""",
            _nodes("detail", "sector", "subsector"),
        ),
        "subsector_flow_links_per_klu": _with(
            _links("sector, subsector, klu, gross_py, gross_cy", "detail", "sector", "subsector")
            + " where sector <> ''",
            SUBSECTORS,
            _nodes("detail", "sector", "subsector"),
        ),
        "column_profile": _with(
            _profile("report", PROFILED),
            _sector_yoy(keys=", payer"),
            f"report as (select *, {RISES} from sectors)",
        ),
        "column_profile_faceted": _with(
            _profile(
                "report",
                PROFILED,
                {n: f"{SECTOR_FACET} and {GROSS_FACET}" for n, _ in PROFILED}
                | {"sector": "true", "gross_cy": SECTOR_FACET},
            ),
            _sector_yoy(keys=", payer"),
            f"report as (select *, {RISES} from sectors)",
        ),
        "column_profile_inferred": _with(
            _profile(
                "report",
                [
                    ("day_first", "date:%d/%m/%Y"), ("dotted", "date:%d.%m.%Y"),
                    ("either", "date:%m/%d/%Y"), ("sector", "text"), ("gross", "number"),
                ],
                formats={
                    "day_first": "d/M/yyyy[ HH:mm:ss]",
                    "dotted": "d.M.yyyy[ HH:mm:ss]",
                    "either": "M/d/yyyy[ HH:mm:ss]|d/M/yyyy[ HH:mm:ss]",
                },
            ),
            f"""
report as (select strftime(paid_on, '%d/%m/%Y') as day_first, strftime(paid_on, '%-d.%-m.%Y') as dotted,
             strftime(paid_on, '%m/%m/%Y') as either, sector, cast(sum(nominal) as bigint) as gross
           from ledger where {GROSS2} and {CY} group by paid_on, sector)""",
        ),
        "column_profile_daily": _with(
            _profile("report", [("paid_on", "date"), ("sector", "text"), ("gross", "number")]),
            f"""
report as (select paid_on, sector, cast(sum(nominal) as bigint) as gross
           from ledger where {GROSS2} and {CY} group by paid_on, sector)""",
        ),
        "column_profile_date_text": _with(
            _profile("report", [("paid_on", "date:%d/%m/%Y"), ("sector", "text"), ("gross", "number")]),
            f"""
report as (select strftime(paid_on, '%d/%m/%Y') as paid_on, sector, cast(sum(nominal) as bigint) as gross
           from ledger where {GROSS2} and {CY} group by paid_on, sector)""",
        ),
        "apply_column_filters_date_text": _with(
            f"""select strftime(paid_on, '%d/%m/%Y') as paid_on, sector, gross from (
              select paid_on, sector, cast(sum(nominal) as bigint) as gross
              from ledger where {GROSS2} and {CY} group by paid_on, sector)
            where paid_on between date '2000-02-10' and date '2000-04-20'"""
        ),
        "apply_column_filters": _with(
            f"""select * from (select *, {RISES} from sectors)
            where sector in ('BLDG', 'HOME') and gross_cy between 1000000 and 30000000
              and regexp_matches(payer, '00[1-5]$')""",
            _sector_yoy(keys=", payer"),
        ),
        "apply_column_filters_daily": _with(
            f"""select * from (
              select paid_on, sector, cast(sum(nominal) as bigint) as gross
              from ledger where {GROSS2} and {CY} group by paid_on, sector)
            where (sector in ('MACHINERY') or sector is null)
              and paid_on between date '2000-02-10' and date '2000-04-20'"""
        ),
        "officer_contribution": _with(
            """select office, section, officer, gross,
              round(gross / nullif(sum(gross) over (partition by section), 0) * 100, 6) as section_share_pct,
              round(gross / nullif(sum(gross) over (partition by office), 0) * 100, 6) as office_share_pct,
              round(gross / nullif(sum(gross) over (), 0) * 100, 6) as region_share_pct
            from (select office, section, officer, cast(sum(nominal) as bigint) as gross
                  from ledger where pay_year = 2000 and kind <> 'SPMKP' and office <> 'NATION_6'
                  group by office, section, officer)"""
        ),
        "payer_kind_receipts": _with(
            f"""select m.payer_kind, cast(sum(nominal) as bigint) as net
            from ledger left join master m using (npwp15) where {CY} group by m.payer_kind""",
            """
master as (
  select case when c_custkey % 50 = 0 then concat('000000000', cast(c_custkey as varchar))
         else concat('9', cast(1000000 + c_custkey as varchar)) end as npwp15,
    case when c_acctbal < 0 then 'BADAN' else 'OP' end as payer_kind
  from customer
)""",
        ),
        "plan_vs_actual": f"""
            select *, {_unit_label('amount', 1)} as amount_label
            from (select cast(month(o_orderdate) as int) as pay_month,
                    o_orderpriority as plan_kind,
                    cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as amount
                  from orders
                  where o_orderdate is not null and o_orderpriority is not null group by all)""",
        "period_delta": _with(
            f"""select gross_cy, net_py, gross_cy - net_py as difference,
              round(case when net_py = 0 or gross_cy = net_py then 0.0
                    else (gross_cy - net_py) / net_py end * 100, 6) as growth_pct,
              round(gross_cy / (select sum(target_cy) from targets) * 100, 6) as target_share_pct,
              {_target_label('gross_cy', 1)} as gross_label,
              {_target_label('net_py', 1)} as net_py_label,
              {_target_label('(gross_cy - net_py)', 1)} as difference_label
            from (select
              cast(sum(nominal) filter (where {CY} and kind <> 'SPMKP') as bigint) as gross_cy,
              cast(sum(nominal) filter (where {PY}) as bigint) as net_py from ledger)"""
        ),
    }
    q["export_report"] = q["top10_payers_per_office"]
    q["export_report_csv"] = q["sector_daily"]
    q["largest_payers"] = f"select * from ({q['payer_bands_net']}) where row_kind = 'payer'"
    q["ledger_table"] = q["sector_payer_yoy"]
    q["ledger_table_compact"] = q["sector_month_yoy"]
    q["top10_payers_per_office_bucketed"] = q["top10_payers_per_office"]
    q["ledger_table_refreshed"] = q["sector_payer_yoy"]
    q["filter_options_stored"] = q["filter_options"]
    for name in ("monthly_growth", "sector_yoy_chosen", "payer_totals"):
        q[f"routed_{name}"] = q[name]
    for name in PAGE:
        q[f"page_{name}"] = q[name]
    return q


OFFICES = f"""
attained as (
  select *, net_cy / nullif(target_cy, 0) * 100 as attainment,
    (net_cy - net_py) / nullif(target_py, 0) * 100 as growth
  from (select office, {_pivot_sum('py')} as net_py, {_pivot_sum('cy')} as net_cy
        from both_periods group by office) join targets using (office)
)"""
