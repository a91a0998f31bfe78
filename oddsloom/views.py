"""Match-domain views over the generic star-schema tables.

Prime denominators in the odds keep derived probabilities off decimal rounding ties.
``Tables`` gives each view as a DataFrame; ``VIEW_SQL`` holds the same text for the SQL side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

MATCHES_SQL = """
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS date, lg AS league,
  CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS season,
  concat(lg, '-T', CAST(h AS STRING)) AS home, concat(lg, '-T', CAST(a AS STRING)) AS away,
  CASE WHEN o_orderstatus <> 'P' THEN p % 4 + CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END END AS fthg,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(p / 7.0e0) AS BIGINT) % 3 + CASE WHEN a % 5 = 0 THEN 1 ELSE 0 END END AS ftag,
  CASE WHEN o_orderkey % 41 <> 0 THEN 1.0e0 / (ph * mg) END AS odds_h,
  CASE WHEN o_orderkey % 41 <> 0 THEN 1.0e0 / (pd * mg) END AS odds_d,
  CASE WHEN o_orderkey % 41 <> 0 THEN 1.0e0 / ((1.0e0 - ph - pd) * mg) END AS odds_a,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 10 < 7 THEN 'pinnacle_close'
       WHEN o_orderkey % 10 < 9 THEN 'avg_close' ELSE 'pinnacle_open' END AS odds_source,
  1.0e0 / ((ph + 0.02e0 * ((o_orderkey % 7) - 3) / 3.0e0) * 1.05e0) AS open_h,
  1.0e0 / (pd * 1.05e0) AS open_d,
  1.0e0 / ((1.0e0 - pd - ph - 0.02e0 * ((o_orderkey % 7) - 3) / 3.0e0) * 1.05e0) AS open_a,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderstatus <> 'P' THEN 0.7e0 * (p % 4) + (o_orderkey % 13) / 20.0e0 END AS xg_home,
  CASE WHEN o_orderkey % 17 <> 0 AND o_orderstatus <> 'P' THEN 0.7e0 * (CAST(floor(p / 7.0e0) AS BIGINT) % 3) + (o_orderkey % 11) / 20.0e0 END AS xg_away,
  ((o_orderkey % 9) - 4) / 4.0e0 AS ah_line
FROM (SELECT *, (h + 1 + o_orderkey % 19) % 20 AS a,
        0.30e0 + 0.25e0 * (o_orderkey % 97) / 97.0e0 AS ph, 0.22e0 + 0.06e0 * (o_orderkey % 31) / 31.0e0 AS pd,
        1.02e0 + 0.01e0 * (o_orderkey % 7) AS mg
      FROM (SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'E0' WHEN 1 THEN 'SP1' ELSE 'F1' END AS lg,
              CAST(floor(o_custkey / 3.0e0) AS BIGINT) % 20 AS h, CAST(floor(o_totalprice) AS BIGINT) AS p FROM {orders}) o1) o2
"""

BOOK_ODDS_SQL = """
SELECT m.league, m.home, m.away, o.o_orderdate AS commence_time,
  o.o_orderdate - INTERVAL '1' DAY * (CAST(floor(o.o_orderkey / 4.0e0) AS BIGINT) % 4 - 1 + CASE WHEN l.l_linenumber > 3 THEN l.l_suppkey % 2 ELSE 0 END) AS fetched_at,
  CASE (o.o_orderkey + CASE WHEN l.l_linenumber > 3 THEN 1 + l.l_suppkey % 2 ELSE 0 END) % 4 WHEN 0 THEN 'pinnacle' WHEN 1 THEN 'winamax_fr' WHEN 2 THEN 'betclic_fr' ELSE 'pmu_fr' END AS book,
  CASE WHEN l.l_linenumber <= 5 THEN 'h2h' ELSE 'totals' END AS market,
  CASE l.l_linenumber WHEN 1 THEN 'home' WHEN 2 THEN 'draw' WHEN 3 THEN 'away' WHEN 4 THEN 'home' WHEN 5 THEN 'draw' WHEN 6 THEN 'Over' ELSE 'Under' END AS outcome,
  CASE WHEN l.l_linenumber <= 5 THEN NULL ELSE 2.5e0 END AS point,
  1.2e0 + (l.l_partkey % 400) / 100.0e0 AS price
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {matches_v} m ON m.match_id = o.o_orderkey
"""

XG_SQL = """
SELECT CASE WHEN match_id % 23 = 0 THEN away ELSE home END AS home, CASE WHEN match_id % 23 = 0 THEN home ELSE away END AS away,
  CAST(date + INTERVAL '1' DAY * (match_id % 5 - 2) AS DATE) AS date,
  CASE WHEN match_id % 23 = 0 THEN xg_away ELSE xg_home END AS xg_home, CASE WHEN match_id % 23 = 0 THEN xg_home ELSE xg_away END AS xg_away, match_id AS seq
FROM {matches_v} WHERE xg_home IS NOT NULL
"""

BETS_SQL = """
SELECT match_id, league, home, away, date, CASE match_id % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' ELSE 'away' END AS issue,
  1.5e0 + (match_id % 50) / 10.0e0 AS odds, 0.005e0 + 0.001e0 * (match_id % 40) AS stake_pct,
  CASE WHEN match_id % 11 = 0 THEN NULL ELSE match_id % 9 END AS odds_age_days, fthg, ftag
FROM {matches_v}
"""

# Scoring rates given from the data itself, so that score-grid work has an exact SQL twin.
RATES_SQL = """
SELECT match_id, date, league, season, home, away, fthg, ftag, odds_h, odds_d, odds_a, odds_source,
  open_h, open_d, open_a, ah_line,
  0.9e0 + 1.1e0 / open_h AS lam_h, 0.5e0 + 1.3e0 / open_a AS lam_a, 0.02e0 * ((match_id % 9) - 4) AS rho
FROM {matches_v}
"""

VIEW_SQL = {
    "matches_v": MATCHES_SQL,
    "book_odds_v": BOOK_ODDS_SQL,
    "xg_v": XG_SQL,
    "bets_v": BETS_SQL,
    "rates_v": RATES_SQL,
}


class Tables:
    """The raw tables of one data folder and the match-domain views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, sql: str, **inputs: DataFrame) -> DataFrame:
        return self.spark.sql(sql, **inputs)

    @cached_property
    def orders(self) -> DataFrame:
        columns = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        return self.raw("orders").select(*columns)

    @cached_property
    def matches(self) -> DataFrame:
        return self._view(MATCHES_SQL, orders=self.orders)

    @cached_property
    def played(self) -> DataFrame:
        return self.matches.filter("fthg IS NOT NULL")

    @cached_property
    def book_odds(self) -> DataFrame:
        # One order is one match: the match columns are computed on the order row itself, so both
        # roles of the SQL text collapse into one shuffle on the order key.
        sql = MATCHES_SQL.replace("AS ah_line\n", "AS ah_line, o_orderdate, o_orderkey\n")
        body = BOOK_ODDS_SQL.split("FROM {lineitem}")[0].replace("m.", "o.")
        return self._view(
            body + "FROM {lineitem} l JOIN {dated} o ON l.l_orderkey = o.o_orderkey",
            lineitem=self.raw("lineitem"),
            dated=self._view(sql, orders=self.orders),
        )

    @cached_property
    def xg(self) -> DataFrame:
        return self._view(XG_SQL, matches_v=self.matches)

    @cached_property
    def bets(self) -> DataFrame:
        return self._view(BETS_SQL, matches_v=self.matches)

    @cached_property
    def rates(self) -> DataFrame:
        return self._view(RATES_SQL, matches_v=self.matches)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions that it mentions, as one WITH list."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name in text and name not in needed:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    names = {name: name for name in (*RAW_TABLES, *VIEW_SQL)}
    # MATERIALIZED: evaluate each view once even when the statement uses it several times.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n].format(**names)})" for n in needed)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        if rest[:9].upper() == "RECURSIVE":
            return f"WITH RECURSIVE {ctes},\n{rest[9:]}"
        return f"WITH {ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
