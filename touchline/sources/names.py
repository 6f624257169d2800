"""Names of raw columns and teams."""

# Raw header -> canonical column.
RAW_COLUMNS = {
    "Date": "date", "Time": "time", "HomeTeam": "team_home", "AwayTeam": "team_away",
    "FTHG": "goals_home", "FTAG": "goals_away", "FTR": "result",
    "HTHG": "half_time_goals_home", "HTAG": "half_time_goals_away", "HTR": "half_time_result",
    "HS": "shots_home", "AS": "shots_away", "HST": "shots_on_target_home", "AST": "shots_on_target_away",
    "HC": "corners_home", "AC": "corners_away", "HY": "yellow_cards_home", "AY": "yellow_cards_away",
    "HR": "red_cards_home", "AR": "red_cards_away", "Referee": "referee",
    "B365H": "odds_b365_home", "B365D": "odds_b365_draw", "B365A": "odds_b365_away",
    "AvgH": "odds_avg_home", "AvgD": "odds_avg_draw", "AvgA": "odds_avg_away",
    "MaxH": "odds_max_home", "MaxD": "odds_max_draw", "MaxA": "odds_max_away",
}

# Headers that were already lower-cased by another reader; odds carry an underscore there.
SLUGGED_COLUMNS = {
    "fthg": "goals_home", "ftag": "goals_away", "ftr": "result",
    "hthg": "half_time_goals_home", "htag": "half_time_goals_away", "htr": "half_time_result",
    "hs": "shots_home", "as": "shots_away", "hst": "shots_on_target_home", "ast": "shots_on_target_away",
    "hc": "corners_home", "ac": "corners_away", "hy": "yellow_cards_home", "ay": "yellow_cards_away",
    "hr": "red_cards_home", "ar": "red_cards_away",
    "b365_h": "odds_b365_home", "b365_d": "odds_b365_draw", "b365_a": "odds_b365_away",
    "avg_h": "odds_avg_home", "avg_d": "odds_avg_draw", "avg_a": "odds_avg_away",
    "max_h": "odds_max_home", "max_d": "odds_max_draw", "max_a": "odds_max_away",
}

# Short team name -> canonical name.
TEAM_NAMES = {
    "Brighton": "Brighton & Hove Albion", "Ipswich": "Ipswich Town", "Leeds": "Leeds United",
    "Leicester": "Leicester City", "Luton": "Luton Town", "Man City": "Manchester City",
    "Man United": "Manchester United", "Newcastle": "Newcastle United", "Norwich": "Norwich City",
    "Nott'm Forest": "Nottingham Forest", "Sheffield Utd": "Sheffield United", "Tottenham": "Tottenham Hotspur",
    "West Brom": "West Bromwich Albion", "West Ham": "West Ham United", "Wolves": "Wolverhampton Wanderers",
}
