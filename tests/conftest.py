import datetime
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from touchline.session import build_session  # noqa: E402

COLUMNS = ("match_id long, competition string, season string, match_date date, team_home string, team_away string, "
           "goals_home int, goals_away int, result string, shots_home int, shots_away int, shots_on_target_home int, "
           "shots_on_target_away int, yellow_cards_home int, yellow_cards_away int, referee string")


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


def random_matches(seed=3, competitions=("A", "B"), seasons=("2001", "2002", "2003"), teams=6, days=40, per_day=3):
    """Several matches a day, also of the same team and pair, teams changing by season."""
    rng, rows = random.Random(seed), []
    for c in competitions:
        for s in seasons:
            names = [f"T{i}" for i in range(teams + 2) if (i + int(s)) % (teams + 2) > 1]
            for day in range(days):
                date = datetime.date(int(s), 1, 1) + datetime.timedelta(days=day * 3)
                for _ in range(rng.randint(1, per_day)):
                    h, a = rng.sample(names, 2)
                    gh, ga = rng.randint(0, 4), rng.randint(0, 3)
                    rows.append((len(rows) + 1, c, s, date, h, a, gh, ga, "H" if gh > ga else "A" if gh < ga else "D",
                                 gh + rng.randint(3, 9), ga + rng.randint(3, 8), gh + rng.randint(0, 2), ga + rng.randint(0, 2),
                                 rng.randint(0, 4), rng.randint(0, 4), f"R{rng.randint(0, 3)}"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return random_matches()


@pytest.fixture(scope="session")
def matches(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).cache()
