"""SQL blocks of the count models: weighted cells, unrolled sweeps, lookups and grids."""

from touchline.operators.counts import LEAST_MASS, RATES, SWEEPS, TARGETS
from touchline.plans.blocks import BLOCKS

_COLUMNS = ("goals", "shots", "shots_on_target", "corners", "yellow_cards", "red_cards")
BLOCKS["sides"] = (("matches",), "\n  UNION ALL\n".join(
    f"  SELECT competition, season, match_date, team_{a} AS team, team_{b} AS opponent, {h} AS is_home, "
    + ", ".join(f"CAST({c}_{a} AS DOUBLE) AS {c}" for c in _COLUMNS) + " FROM matches"
    for a, b, h in (("home", "away", 1), ("away", "home", 0))), "MATERIALIZED ")

BLOCKS["season_roles"] = (("matches",), """
  WITH s AS (SELECT season, row_number() OVER (ORDER BY season) AS r FROM (SELECT DISTINCT season FROM matches WHERE season <> '2001'))
  SELECT a.season, b.r - 4 AS fold, CASE WHEN a.r < b.r THEN 'train' ELSE 'validation' END AS part
  FROM s a JOIN s b ON b.r > 4 AND a.r <= b.r""", "MATERIALIZED ")


def cells_block(name, targets, decays=(0.0018,), folds=False, scope="season <> '2001'"):
    rows = []
    for t in targets:
        y, e = TARGETS[t]
        rows.append(f"SELECT s.*, '{t}' AS target, {y} AS y, {e if e else '1e0'} AS e FROM sides s WHERE {scope}"
                    + (f" AND {e} >= 1" if e else ""))
    fold = ", fold" if folds else ""
    roles = " JOIN season_roles r ON r.season = l.season AND r.part = 'train'" if folds else ""
    xs = ", ".join(f"{x!r}e0" if "e" not in repr(x) else repr(x) for x in decays)
    BLOCKS[name] = (("sides",) + (("season_roles",) if folds else ()), f"""
  WITH l AS ({' UNION ALL '.join(rows)}),
  f AS (SELECT l.*{', r.fold' if folds else ''} FROM l{roles}),
  b AS (SELECT competition{fold}, max(match_date) AS base_date FROM f GROUP BY ALL),
  x AS (SELECT f.*, b.base_date, unnest([{xs}]) AS xi FROM f JOIN b USING (competition{fold}))
  SELECT competition, target, xi{fold}, team, opponent, is_home,
    sum(exp(-xi * date_diff('day', match_date, base_date)) * y) AS wy,
    sum(exp(-xi * date_diff('day', match_date, base_date)) * e) AS we FROM x GROUP BY ALL""", "MATERIALIZED ")


def rates_block(name, cells, folds=False, sweeps=SWEEPS):
    keys = ["competition", "target", "xi"] + (["fold"] if folds else [])
    k = ", ".join(keys)
    ck = ", ".join(f"c.{x}" for x in keys)
    least = f"greatest(sum(wy), {LEAST_MASS}e0)"
    rate = "(" + ", ".join(f"'{r}'" for r in RATES) + ")"
    parts = [f"tm AS MATERIALIZED (SELECT {k}, team FROM {cells} UNION SELECT {k}, opponent FROM {cells})",
             f"d0 AS (SELECT *, 0e0 AS v FROM tm)", f"h0 AS (SELECT DISTINCT {k}, 0e0 AS v FROM tm)"]

    def half(new, old, of, other, h):
        return f"""{new} AS MATERIALIZED (SELECT tm.*, coalesce(z.v, 0e0) AS v FROM tm LEFT JOIN (SELECT {ck}, c.{of} AS team,
      ln({least} / sum(we * exp(p.v + h.v * is_home))) AS v FROM {cells} c JOIN {old} p ON {_eq('p', keys)} AND p.team = c.{other}
      JOIN {h} h ON {_eq('h', keys)} GROUP BY ALL) z USING ({k}, team))"""

    for i in range(1, sweeps + 1):
        parts.append(half(f"a{i}", f"d{i - 1}", "team", "opponent", f"h{i - 1}"))
        parts.append(half(f"d{i}", f"a{i}", "opponent", "team", f"h{i - 1}"))
        parts.append(f"""h{i} AS MATERIALIZED (SELECT {ck}, CASE WHEN c.target IN {rate} THEN greatest(ln({least}
      / sum(we * exp(p.v + q.v))), 0e0) ELSE ln({least} / sum(we * exp(p.v + q.v))) END AS v FROM {cells} c
      JOIN a{i} p ON {_eq('p', keys)} AND p.team = c.team JOIN d{i} q ON {_eq('q', keys)} AND q.team = c.opponent
      WHERE is_home = 1 GROUP BY {ck})""")
    BLOCKS[name] = ((cells,), f"""
  WITH {', '.join(parts)},
  g AS (SELECT {k}, 1 - avg(v) AS shift FROM a{sweeps} GROUP BY ALL)
  SELECT a.*  EXCLUDE (v), a.v + g.shift AS attack, d.v - g.shift AS defense, h.v AS home_advantage
  FROM a{sweeps} a JOIN d{sweeps} d USING ({k}, team) JOIN h{sweeps} h USING ({k}) JOIN g USING ({k})""", "MATERIALIZED ")


def _eq(alias, keys):
    return " AND ".join(f"{alias}.{x} = c.{x}" for x in keys)


def expected_block(name, fixtures, rates, folds=False):
    keys = ["competition"] + (["fold"] if folds else [])
    fit = keys + ["target", "xi"]
    side = lambda s: f"LEFT JOIN {rates} {s} ON " + " AND ".join(f"{s}.{x} = l.{x}" for x in fit) + f" AND {s}.team = f.team_{'home' if s == 'h' else 'away'}"
    BLOCKS[name] = ((rates,) + ((fixtures,) if fixtures in BLOCKS else ()), f"""
  WITH l AS (SELECT {', '.join(fit)}, avg(attack) AS ma, avg(defense) AS md, any_value(home_advantage) AS home_advantage FROM {rates} GROUP BY ALL)
  SELECT f.*, l.target, l.xi, exp(l.home_advantage + coalesce(h.attack, ma) + coalesce(a.defense, md)) AS expected_home,
    exp(coalesce(a.attack, ma) + coalesce(h.defense, md)) AS expected_away, h.team IS NULL OR a.team IS NULL AS cold_start
  FROM {fixtures} f JOIN l USING ({', '.join(keys)}) {side('h')} {side('a')}""", "MATERIALIZED ")


def grid_sql(source, key, size=15, where="true", rho="0e0"):
    """Cells i, j, p (normalised, low-score term included) of every row of ``source``."""
    return f"""
  SELECT {key}, i, j, p / sum(p) OVER (PARTITION BY {key}) AS p FROM (
    SELECT {key}, i, j, exp(-expected_home + i * ln(expected_home) - lgamma(i + 1e0)) * exp(-expected_away + j * ln(expected_away) - lgamma(j + 1e0))
      * CASE WHEN i = 0 AND j = 0 THEN 1 - expected_home * expected_away * {rho} WHEN i = 0 AND j = 1 THEN 1 + expected_home * {rho}
          WHEN i = 1 AND j = 0 THEN 1 + expected_away * {rho} WHEN i = 1 AND j = 1 THEN 1 - {rho} ELSE 1 END AS p
    FROM {source}, (SELECT unnest(range({size})) AS i), (SELECT unnest(range({size})) AS j) WHERE {where})"""


cells_block("train_cells", ("goals", "corners", "yellow", "red", "shots"))
rates_block("train_rates", "train_cells")
BLOCKS["pairs"] = (("matches",), "SELECT DISTINCT competition, team_home, team_away FROM matches WHERE season = '2001'", "MATERIALIZED ")
expected_block("pair_rates", "pairs", "train_rates")
def rho_block(name, rates, folds=False):
    fold = ", fold" if folds else ""
    on = lambda s: f"{s}.target = 'goals' AND {s}.competition = m.competition" + (f" AND {s}.fold = m.fold" if folds else "")
    rows = ("(SELECT m.*, r.fold FROM matches m JOIN season_roles r ON r.season = m.season AND r.part = 'train')" if folds
            else "(SELECT * FROM matches WHERE season <> '2001')")
    BLOCKS[name] = (("matches", rates) + (("season_roles",) if folds else ()), f"""
  WITH m AS {rows}, b AS (SELECT competition{fold}, max(match_date) AS base_date FROM m GROUP BY ALL),
  c AS (
    SELECT m.competition{", m.fold" if folds else ""}, goals_home AS i, goals_away AS j, exp(-0.0018e0 * date_diff('day', match_date, base_date)) AS w,
      exp(h.home_advantage + h.attack + a.defense) AS lam, exp(a.attack + h.defense) AS mu
    FROM m JOIN b USING (competition{fold}) JOIN {rates} h ON {on("h")} AND h.team = m.team_home
    JOIN {rates} a ON {on("a")} AND a.team = m.team_away WHERE goals_home <= 1 AND goals_away <= 1),
  r AS (SELECT competition{fold}, rho, sum(w * ln(greatest(CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * rho WHEN i = 0 THEN 1 + lam * rho
      WHEN j = 0 THEN 1 + mu * rho ELSE 1 - rho END, 1e-10))) AS gain
    FROM c, (SELECT round(-0.2e0 + 0.01e0 * unnest(range(41)), 2) AS rho) GROUP BY ALL)
  SELECT competition{fold}, min_by(rho, struct_pack(a := round(-gain, 7), b := abs(rho), c := rho)) AS rho, max(gain) AS gain
  FROM r GROUP BY competition{fold}""", "MATERIALIZED ")


rho_block("rho", "train_rates")
BLOCKS["pair_grid"] = (("pair_rates",), grid_sql("pair_rates", "competition, team_home, team_away", where="target = 'goals'"), "MATERIALIZED ")
BLOCKS["pair_rates_rho"] = (("pair_rates", "rho"), "SELECT p.*, r.rho FROM pair_rates p JOIN rho r USING (competition) WHERE target = 'goals'", "MATERIALIZED ")
BLOCKS["pair_grid_rho"] = (("pair_rates_rho",), grid_sql("pair_rates_rho", "competition, team_home, team_away", rho="rho"), "MATERIALIZED ")
