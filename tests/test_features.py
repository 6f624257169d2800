"""Features against a plain loop over days, and the point-in-time invariants."""

from collections import defaultdict

from pyspark.sql import functions as F

from touchline.operators.features import generate_features
from touchline.schema import FEATURE_COLUMNS


def by_hand(history, targets):
    """Snapshot each target from the history of strictly earlier days."""
    out = {}
    for t in targets:
        mid, comp, season, date, home, away = t[:6]
        past = sorted((m for m in history if m[1] == comp and m[3] < date), key=lambda m: (m[3], m[0]))
        row = {}
        for side, team in (("home", home), ("away", away)):
            mine = [m for m in past if team in (m[4], m[5])][-5:]
            gd = [(m[6] - m[7]) * (1 if m[4] == team else -1) for m in mine]
            row |= {f"{side}_form5_played": len(mine), f"{side}_form5_wins": sum(g > 0 for g in gd),
                    f"{side}_form5_draws": sum(g == 0 for g in gd), f"{side}_form5_losses": sum(g < 0 for g in gd),
                    f"{side}_form5_goal_difference": sum(gd)}
            last = [m[3] for m in past if team in (m[4], m[5])]
            row[f"{side}_rest_days"] = (date - max(last)).days if last else None
            own = [m for m in past if m[2] == season and m[4 if side == "home" else 5] == team]
            sgd = [(m[6] - m[7]) * (1 if side == "home" else -1) for m in own]
            n = len(own)
            row |= {f"{side}_{side}_played": n, f"{side}_{side}_wins": sum(g > 0 for g in sgd),
                    f"{side}_{side}_draws": sum(g == 0 for g in sgd), f"{side}_{side}_losses": sum(g < 0 for g in sgd),
                    f"{side}_{side}_points_per_game": sum(3 if g > 0 else g == 0 for g in sgd) / n if n else None,
                    f"{side}_{side}_goal_difference_per_game": sum(sgd) / n if n else None}
        meet = [m for m in past if {m[4], m[5]} == {home, away}][-5:]
        winner = [m[4] if m[6] > m[7] else m[5] if m[6] < m[7] else None for m in meet]
        row |= {"h2h_played": len(meet), "h2h_home_wins": winner.count(home), "h2h_away_wins": winner.count(away),
                "h2h_draws": winner.count(None)}
        table = defaultdict(lambda: [0, 0, 0, 0])
        members = {x for m in history if m[1] == comp and m[2] == season for x in m[4:6]}
        members |= {x for f in targets if f[1] == comp and f[2] == season and f[3] == date for x in f[4:6]}
        for x in members:
            table[x]
        for m in past:
            if m[2] == season:
                for team, gf, ga in ((m[4], m[6], m[7]), (m[5], m[7], m[6])):
                    r = table[team]
                    r[0] += 3 if gf > ga else 1 if gf == ga else 0
                    r[1] += gf - ga
                    r[2] += gf
                    r[3] += 1
        for side, team in (("home", home), ("away", away)):
            row |= {f"{side}_league_points": table[team][0], f"{side}_league_played": table[team][3],
                    f"{side}_league_position": 1 + sum(table[x][:3] > table[team][:3] for x in table)}
        row["is_empty_stadium"] = 0
        out[mid] = row
    return out


def check(found, expected):
    assert len(found) == len(expected)
    for row in found:
        for c in FEATURE_COLUMNS:
            a, b = row[c], expected[row["match_id"]][c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (row["match_id"], c, a, b)


def test_features_match_a_loop_over_days(matches, rows):
    check(generate_features(matches).collect(), by_hand(rows, rows))


def test_fixture_features_ignore_other_fixtures(matches, rows):
    history = [r for r in rows if r[2] != "2003" or r[3].month == 1]
    fixtures = [r for r in rows if r[2] == "2003" and r[3].month > 1]
    ids = [r[0] for r in fixtures]
    past = matches.where(~F.col("match_id").isin(ids))
    asked = matches.where(F.col("match_id").isin(ids)).select("match_id", "competition", "season", "match_date", "team_home", "team_away")
    check(generate_features(past, asked).collect(), by_hand(history, fixtures))


def test_removing_the_future_changes_nothing(matches):
    cut = F.to_date(F.lit("2002-02-01"))
    early = generate_features(matches.where(F.col("match_date") < cut)).drop("home_league_position", "away_league_position")
    full = generate_features(matches).where(F.col("match_date") < cut).drop("home_league_position", "away_league_position")
    assert early.exceptAll(full).count() == 0 and full.exceptAll(early).count() == 0
