"""SQL of the registered queries, on the same tables. Shared steps are common table expressions."""

from __future__ import annotations

from tapewatch.functions.text import CATEGORY_RULES, EXCLUDED, FALLBACK_RULES, TAXONOMY_RULES
from tapewatch.operators.publish import CARDS
from tapewatch.operators.surveillance import BASELINE, MULTIPLIER
from tapewatch.sources.driver import SQL as VIEWS
from tapewatch.sources.driver import sql_entities, sql_question


def _leg(o: str) -> str:
    own, n = f"outcome = '{o}'", o.lower()
    return f"""
      sum(CASE WHEN {own} AND side <> 'SELL' THEN size ELSE 0 END) AS {n}_bought, sum(CASE WHEN {own} AND side = 'SELL' THEN size ELSE 0 END) AS {n}_sold,
      sum(CASE WHEN {own} AND side <> 'SELL' THEN size * price ELSE 0 END) AS {n}_cost, sum(CASE WHEN {own} AND side = 'SELL' THEN size * price ELSE 0 END) AS {n}_proceeds,
      sum(CASE WHEN {own} AND side <> 'SELL' AND last_ts - ts BETWEEN 0 AND 172800 THEN size * price ELSE 0 END) AS {n}_late,
      min(CASE WHEN {own} AND side <> 'SELL' THEN ts END) AS {n}_ts, arg_min(CASE WHEN {own} AND side <> 'SELL' THEN tx END, CASE WHEN {own} AND side <> 'SELL' THEN ts * 1000000000 + tx END) AS {n}_tx"""


POSITIONS = f"""WITH {VIEWS}, last AS (SELECT cond, max(ts) AS last_ts FROM trades GROUP BY cond
), legs AS (
  SELECT t.cond, t.wallet, {_leg("YES")}, {_leg("NO")}
  FROM trades t JOIN last USING (cond) GROUP BY t.cond, t.wallet
), wide AS (
  SELECT l.*, c.winner, c.event_group, c.category, c.resolved_ts, c.corr_key, c.question, yes_bought > 0 AND (no_bought <= 0 OR yes_cost > no_cost) AS is_yes
  FROM legs l JOIN catalog c USING (cond) WHERE yes_bought > 0 OR no_bought > 0
), own AS (
  SELECT *, CASE WHEN is_yes THEN 'YES' ELSE 'NO' END AS outcome, CASE WHEN is_yes THEN yes_bought ELSE no_bought END AS bought,
    CASE WHEN is_yes THEN yes_sold ELSE no_sold END AS sold, CASE WHEN is_yes THEN yes_cost ELSE no_cost END AS cost,
    CASE WHEN is_yes THEN yes_late ELSE no_late END AS late_cost, CASE WHEN is_yes THEN no_bought ELSE yes_bought END AS other_bought,
    CASE WHEN is_yes THEN yes_ts ELSE no_ts END AS ts, CASE WHEN is_yes THEN yes_tx ELSE no_tx END AS tx,
    CASE WHEN winner = 'YES' THEN yes_bought - yes_sold ELSE no_bought - no_sold END AS winning
  FROM wide
), positions AS (
  SELECT cond, wallet, event_group, category, resolved_ts, corr_key, question, outcome, greatest(0.0001, least(0.9999, cost / bought)) AS entry, cost AS gross,
    greatest(0.0, yes_cost + no_cost - yes_proceeds - no_proceeds) AS stake,
    yes_proceeds + no_proceeds + greatest(0.0, winning) - yes_cost - no_cost AS pnl, outcome = winner AS won, sold < 0.03 * bought AS held,
    CASE WHEN cost > 0 THEN greatest(0.0, least(1.0, late_cost / cost)) ELSE 0.0 END AS late,
    greatest(0.0, least(1.0, 1 - (sold + other_bought) / bought)) AS directional, ts, tx
  FROM own
)"""

BETS = (
    POSITIONS
    + """, peers AS (
  SELECT cond, avg(stake) AS mean_stake, stddev_samp(stake) AS sd_stake, avg(pnl) AS mean_profit, stddev_samp(pnl) AS sd_profit, count(*) AS buyers, sum(gross) AS market_volume
  FROM positions GROUP BY cond
), crossed AS (
  SELECT p.*, buyers,
    CASE WHEN buyers >= 3 AND market_volume >= 10000 AND stake >= 500 AND sd_stake > 0 THEN (stake - mean_stake) / sd_stake END AS z_bet,
    CASE WHEN buyers >= 3 AND market_volume >= 10000 AND stake >= 500 AND sd_profit > 0 THEN (pnl - mean_profit) / sd_profit END AS z_profit
  FROM positions p JOIN peers USING (cond)
), bins AS (
  SELECT cond, (ts // 3600) * 3600 AS hour, avg(price) AS p, count(*) AS n FROM trades GROUP BY 1, 2
), steps AS (
  SELECT *, abs(p - lag(p) OVER (PARTITION BY cond ORDER BY hour)) AS step FROM bins
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY cond ORDER BY step DESC NULLS LAST, hour) AS r FROM steps
), shock AS (
  SELECT cond, max(CASE WHEN r = 1 THEN hour END) AS shock_ts, max(step) AS move FROM ranked GROUP BY cond
  HAVING sum(n) >= 8 AND count(*) >= 3 AND max(step) >= 0.15
), bets AS (SELECT c.*, s.shock_ts FROM crossed c LEFT JOIN shock s USING (cond))"""
)

_HOURS = "CASE WHEN ls AND won AND entry <= 0.2 AND coalesce(shock_ts, resolved_ts) > ts THEN (coalesce(shock_ts, resolved_ts) - ts) / 3600.0::DOUBLE END"
RECORDS = (
    BETS
    + f""", marked AS (
  SELECT *, entry <= 0.35 AS ls, greatest(0.000001, least(0.999999, entry)) AS p FROM bets
), timed AS (SELECT *, {_HOURS} AS hours, ls AND won AND entry <= 0.15 AND held AS cheap FROM marked
), gr AS (
  SELECT wallet, corr_key, count(*) FILTER (WHERE ls) AS ls_n, count(*) FILTER (WHERE ls AND won) AS ls_wins, avg(p) FILTER (WHERE ls) AS ls_p, count(*) AS n, count(*) FILTER (WHERE won) AS wins, avg(p) AS p,
    count(*) FILTER (WHERE won AND entry <= 0.5) AS surprises
  FROM timed GROUP BY wallet, corr_key
), gw AS (
  SELECT wallet, count(*) FILTER (WHERE ls_n > 0) AS ls_groups, count(*) FILTER (WHERE ls_n > 0 AND 2 * ls_wins >= ls_n) AS ls_won, avg(ls_p) AS ls_p, count(*) AS groups, count(*) FILTER (WHERE 2 * wins >= n) AS won_groups,
    sum(p) AS expected, sum(p * (1 - p)) AS variance, count(*) FILTER (WHERE surprises > 0) AS surprising_events
  FROM gr GROUP BY wallet
), ev AS (
  SELECT wallet, event_group, sum(stake) AS stake, sum(CASE WHEN outcome = 'YES' THEN stake ELSE 0 END) AS yes, count(*) FILTER (WHERE cheap) AS cheap, coalesce(sum(stake) FILTER (WHERE cheap), 0) AS cheap_stake,
    coalesce(sum(stake * greatest(0.0001, least(0.9999, entry))) FILTER (WHERE cheap), 0) AS cheap_weighted
  FROM timed GROUP BY wallet, event_group
), top AS (
  SELECT wallet, cheap_stake, cheap_weighted FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY cheap_stake DESC, event_group) AS r FROM ev WHERE cheap > 0) WHERE r = 1
), ew AS (SELECT wallet, sum(stake) AS staked, sum(yes) AS yes, max(stake) AS max_event FROM ev GROUP BY wallet
), medians AS (
  SELECT wallet, list_sort(list(stake))[count(*) // 2 + 1] AS median_stake, count(*) AS staked_bets FROM timed WHERE stake > 0 GROUP BY wallet
), base AS (
  SELECT wallet, count(*) AS bets, count(*) FILTER (WHERE won) AS wins, sum(pnl) AS pnl, sum(entry) / count(*) AS mean_odds, count(*) FILTER (WHERE ls) AS ls_bets, avg(entry) FILTER (WHERE ls) AS ls_mean,
    count(*) FILTER (WHERE ls AND held) / nullif(count(*) FILTER (WHERE ls), 0) AS ls_held, sum(pnl) FILTER (WHERE ls) AS ls_pnl, coalesce(sum(stake) FILTER (WHERE ls), 0) AS ls_staked, max(z_profit) AS z_profit,
    count(*) FILTER (WHERE hours <= 72) AS late_wins, min(hours) AS least_hours, max(stake) AS max_stake, count(*) FILTER (WHERE stake > 0 AND stake < 200) AS decoys, count(*) FILTER (WHERE stake >= 10000) AS reals,
    count(*) FILTER (WHERE entry <= 0.0001 OR entry >= 0.9999) AS bad_entries
  FROM timed GROUP BY wallet
), records AS (
  SELECT b.*, gw.* EXCLUDE (wallet), ew.* EXCLUDE (wallet), t.cheap_stake, t.cheap_weighted, m.median_stake, coalesce(m.staked_bets, 0) AS staked_bets, ac.* EXCLUDE (wallet)
  FROM base b JOIN gw USING (wallet) JOIN ew USING (wallet) LEFT JOIN top t USING (wallet) LEFT JOIN medians m USING (wallet) LEFT JOIN accounts ac USING (wallet)
)"""
)


def _clip(x: str, a: float = 0, b: float = 1) -> str:
    return f"greatest({a}::DOUBLE, least({b}::DOUBLE, {x}))"


_TAIL = """CASE WHEN ls_groups < 5 THEN NULL WHEN ls_won <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range(ls_won, ls_groups + 1),
  lambda i: exp(lgamma(ls_groups + 1) - lgamma(i + 1) - lgamma(ls_groups - i + 1) + i * ln(ls_p) + (ls_groups - i) * ln(1 - ls_p))))) END"""
_Z = "(won_groups - expected) / sqrt(variance)"
_NAMELESS = "coalesce(has_profile AND username IS NULL AND wins >= 3, false)"
_DECOY = f"(coalesce(split_ratio >= 0.5, false)::INT + coalesce(decoys / nullif(reals, 0) >= 0.3, false)::INT + coalesce(cash_out_hours <= 24, false)::INT + {_NAMELESS}::INT)"
_YOUNG = "(age_days <= 14 AND prior_tx = 0)"
_PURITY = "greatest(yes, staked - yes) / staked"
_ODDS = _clip("cheap_weighted / nullif(cheap_stake, 0)", 0.0001, 0.9999)
_RATIO = "(CASE WHEN median_stake > 0 THEN max_event / median_stake ELSE 0 END)"
_CC = f"({_clip(f'({_Z} - 2) / 4')} * CASE WHEN {_Z} >= 3 THEN 1.0 ELSE 0.6 END)"

#: has data, fires, score, measure
DETECTORS = {
    "won": ("ls_groups >= 5", f"{_TAIL} <= 0.01", _clip(f"(log10(greatest({_TAIL}, 1e-15)) + 2) / -4"), _TAIL),
    "crossCat": ("bets >= 5 AND groups >= 5 AND variance > 0 AND expected / groups > 0.35", f"{_Z} >= 3", f"CASE WHEN {_Z} >= 3 THEN {_clip(f'0.45 + 0.55 * {_CC}')} ELSE {_clip(f'0.4 * {_CC}', 0, 0.4)} END", _Z),
    "longshot": ("ls_bets > 0", "round(ls_mean, 9) <= 0.2", f"CASE WHEN round(ls_mean, 9) <= 0.2 THEN {_clip(f'0.45 + 0.55 * {_clip("(0.2 - ls_mean) / 0.2")}')} ELSE {_clip(f'0.3 * {_clip("(0.2 - ls_mean) / 0.2")}', 0, 0.4)} END", "ls_mean"),
    "held": ("ls_bets > 0", "ls_held >= 0.9", f"CASE WHEN ls_held >= 0.9 THEN {_clip('0.4 + (ls_held - 0.9) / 0.1 * 0.6')} ELSE {_clip('0.4 * ls_held', 0, 0.4)} END", "ls_held"),
    "baseline": ("ls_groups >= 5", "round(ls_won / ls_groups - ls_mean, 9) > 0.05", _clip("(ls_won / ls_groups / ls_mean - 1) / 4"), "ls_won / ls_groups - ls_mean"),
    "profitCross": ("z_profit IS NOT NULL", "z_profit >= 2", f"CASE WHEN z_profit >= 2 THEN {_clip(f'0.45 + 0.55 * {_clip("z_profit / 8")}')} ELSE {_clip(f'0.4 * {_clip("z_profit / 8")}', 0, 0.4)} END", "z_profit"),
    "fresh": ("age_days IS NOT NULL AND prior_tx IS NOT NULL", _YOUNG, f"CASE WHEN {_YOUNG} THEN {_clip('1 - age_days / 14', 0.5, 1)} ELSE {_clip('0.3 * (1 - ' + _clip('age_days / 90') + ')', 0, 0.4)} END", "age_days"),
    "cluster": ("mean_link IS NOT NULL", "mean_link >= 0.8", _clip("(mean_link - 0.5) / 0.5"), "mean_link"),
    "newsBlackout": ("news_count IS NOT NULL", "news_count <= 0 AND max_stake >= 1000", f"CASE WHEN news_count <= 0 AND max_stake >= 1000 THEN 0.6 WHEN news_count <= 0 THEN 0.3 ELSE {_clip('0.2 - 0.02 * news_count', 0, 0.25)} END", "news_count::DOUBLE"),
    "fedRegister": ("docs_ahead IS NOT NULL", "docs_ahead >= 1", f"CASE WHEN docs_ahead >= 1 THEN {_clip('0.4 + 0.06 * least(3, docs_ahead)', 0, 0.6)} ELSE 0.0 END", "docs_ahead::DOUBLE"),
    "conceal": (f"split_ratio IS NOT NULL OR reals > 0 OR cash_out_hours IS NOT NULL OR {_NAMELESS}", f"{_DECOY} >= 2", f"CASE WHEN {_DECOY} >= 2 THEN {_clip(f'0.4 + 0.2 * {_DECOY}')} ELSE {_clip(f'0.15 * {_DECOY}', 0, 0.39)} END", f"{_DECOY}::DOUBLE"),
    "conviction": ("cheap_stake IS NOT NULL", f"cheap_stake >= 7500 AND {_ODDS} <= 0.15", f"CASE WHEN cheap_stake >= 7500 AND {_ODDS} <= 0.15 THEN {_clip(f'0.45 + 0.18 * log10(greatest(1.0, cheap_stake / 7500)) + (0.15 - {_ODDS})')} ELSE {_clip('cheap_stake / 7500 * 0.3', 0, 0.39)} END", "cheap_stake"),
    "timing": ("least_hours IS NOT NULL", "late_wins >= 1 AND least_hours <= 72", f"CASE WHEN late_wins >= 1 AND least_hours <= 72 THEN {_clip('0.42 + 0.08 * least(4, late_wins) + (72 - least_hours) / 72 * 0.3')} ELSE {_clip('late_wins * 0.18', 0, 0.39)} END", "least_hours"),
    "repeat": ("surprising_events >= 1", "surprising_events >= 2", f"CASE WHEN surprising_events >= 2 THEN {_clip('0.42 + 0.16 * least(4, surprising_events - 1)')} ELSE 0.2 END", "surprising_events::DOUBLE"),
    "concentration": ("staked_bets >= 3 AND staked > 0", f"{_PURITY} >= 0.95 AND staked >= 10000", f"CASE WHEN {_PURITY} >= 0.95 AND staked >= 10000 THEN {_clip(f'0.46 + ({_PURITY} - 0.95) / 0.05 * 0.3 + (max_event / staked - 0.5) * 0.2')} ELSE {_clip(f'({_PURITY} - 0.5) * 0.6', 0, 0.39)} END", _PURITY),
    "sizing": ("staked_bets >= 4", f"{_RATIO} >= 8 AND max_event >= 3000", f"CASE WHEN {_RATIO} >= 8 AND max_event >= 3000 THEN {_clip(f'0.46 + 0.14 * log10(greatest(1.0, {_RATIO} / 8)) + least(0.2, max_event / 3000 * 0.02)')} ELSE {_clip(f'{_RATIO} / 8 * 0.3', 0, 0.39)} END", _RATIO),
}
NAMES = {
    "binomial_tail": "won", "cross_category": "crossCat", "longshot_record": "longshot", "held_rate": "held", "baseline_lift": "baseline", "profit_cross": "profitCross",
    "fresh_account": "fresh", "cluster_link": "cluster", "blackout_signal": "newsBlackout", "register_signal": "fedRegister", "conceal": "conceal", "conviction": "conviction", "timing": "timing", "repeat_wins": "repeat", "concentration": "concentration", "sizing": "sizing",
}


def _detector(key: str) -> str:
    has, fires, score, measure = DETECTORS[key]
    return f"SELECT wallet, coalesce({fires}, false) AS fires, score, measure FROM (SELECT *, CAST({score} AS DOUBLE) AS score, CAST({measure} AS DOUBLE) AS measure FROM records WHERE {has})"


def _rules(rules, text: str) -> str:
    return " ".join(f"WHEN regexp_matches({text}, '{pattern}') THEN '{name}'" for name, pattern in rules)


def _r(*columns: str, digits: int = 3) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE) + 0.0000001::DOUBLE, {digits}) + 0.0::DOUBLE AS {c.split('.')[-1]}" for c in columns)


def _named(key: str) -> str:
    has, fires, score, measure = DETECTORS[key]
    return f"{RECORDS} SELECT wallet, fires, {_r('score', 'measure')} FROM ({_detector(key)})"


_LONG = " UNION ALL ".join(f"SELECT wallet, '{k}' AS detector, fires, score, measure FROM ({_detector(k)})" for k in DETECTORS if k not in ("newsBlackout", "fedRegister"))
_TIER = """CASE WHEN agreeing >= 2 AND p <= 0.000001 THEN 'extreme' WHEN agreeing >= 2 AND p <= 0.0001 THEN 'high' WHEN agreeing >= 2 AND pc <= 0.0001 THEN 'high'
  WHEN agreeing >= 2 AND conv THEN 'high' WHEN n_fired > 0 AND (p IS NULL OR p <= 0.01 OR pc <= 0.01) THEN 'notable' ELSE 'unflagged' END"""


def _upper(z: str) -> str:
    x = f"({z} / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {x}))"
    return f"((((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}) * exp(-{x} * {x}) / 2)"


def _cdf(z: str) -> str:
    return f"(CASE WHEN {z} >= 0 THEN 1 - {_upper(z)} ELSE {_upper(f'(-({z}))')} END)"


FUSED = (
    RECORDS
    + f""", long AS ({_LONG}), fused AS (
  SELECT r.wallet, coalesce(count(*) FILTER (WHERE l.fires AND l.score >= 0.45), 0) AS agreeing, count(*) FILTER (WHERE l.fires) AS n_fired,
    coalesce(string_agg(l.detector, ',' ORDER BY l.detector) FILTER (WHERE l.fires), '') AS fired, max(l.measure) FILTER (WHERE l.detector = 'won') AS p,
    max(greatest(1e-15, {_upper('greatest(l.measure, 0.0::DOUBLE)')})) FILTER (WHERE l.detector = 'crossCat' AND l.fires) AS pc, coalesce(bool_or(l.fires AND l.detector = 'conviction'), false) AS conv
  FROM records r LEFT JOIN long l USING (wallet) GROUP BY r.wallet
)"""
)
_LOGIT = "ln(greatest(0.001::DOUBLE, least(0.999::DOUBLE, p)) / (1 - greatest(0.001::DOUBLE, least(0.999::DOUBLE, p))))"
_LOGIT2 = "ln(greatest(0.02::DOUBLE, least(0.98::DOUBLE, p)) / (1 - greatest(0.02::DOUBLE, least(0.98::DOUBLE, p))))"
V = f"WITH {VIEWS}"
VOLUMES = V + """, volumes AS (
  SELECT cond, wallet, coalesce(sum(usd) FILTER (WHERE side <> 'SELL'), 0) AS buy_usd, coalesce(sum(usd) FILTER (WHERE side = 'SELL'), 0) AS sell_usd, min(ts) FILTER (WHERE side <> 'SELL') AS first_ts
  FROM trades GROUP BY cond, wallet)"""
RUN_UP = V + f""", z AS (
  SELECT market, t, id, {_LOGIT} AS z, row_number() OVER w AS k, count(*) OVER (PARTITION BY market) AS points FROM series WINDOW w AS (PARTITION BY market ORDER BY t, id)
), r AS (SELECT *, z - lag(z) OVER (PARTITION BY market ORDER BY t, id) AS r, greatest(3, CAST(floor((points - 1) * 0.6::DOUBLE) AS BIGINT)) AS split FROM z
), s AS (
  SELECT market, avg(r) FILTER (WHERE k BETWEEN 2 AND split + 1) AS mu, stddev_pop(r) FILTER (WHERE k BETWEEN 2 AND split + 1) AS sigma, sum(r) FILTER (WHERE k > split + 1) AS moved,
    count(*) FILTER (WHERE k > split + 1) AS n, max(z) FILTER (WHERE k = 1) AS z0, max(z) FILTER (WHERE k = points) AS z1, max(z) FILTER (WHERE k = split + 1) AS zs
  FROM r WHERE points >= 8 GROUP BY market
), c AS (SELECT *, (moved - n * mu) / sigma AS car FROM s WHERE n >= 1 AND sigma > 0), run_up AS (
SELECT market, n, car, car / sqrt(n) AS car_star, {_clip('abs(car / sqrt(n)) / 4')} AS score, CASE WHEN abs(z1 - z0) > 0 THEN {_clip('abs(z1 - zs) / abs(z1 - z0)')} ELSE 0 END AS pre_move FROM c)"""
VPIN = f""", v0 AS (
  SELECT market, t, id, volume, {_LOGIT} AS z FROM series WHERE volume > 0 AND p > 0 AND p < 1
), v1 AS (
  SELECT *, coalesce(z - lag(z) OVER w, 0.0::DOUBLE) AS dz, row_number() OVER w AS k, sum(volume) OVER (PARTITION BY market ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run
  FROM v0 WINDOW w AS (PARTITION BY market ORDER BY t, id)
), v2 AS (
  SELECT *, count(*) OVER m AS n, sum(volume) OVER m / 50 AS size, run - volume AS start, stddev_pop(CASE WHEN k > 1 THEN dz END) OVER m AS sd FROM v1 WINDOW m AS (PARTITION BY market)
), v2b AS (
  SELECT *, {_cdf('(dz / sd)')} AS share, unnest(range(greatest(0, CAST(floor(start / size) AS BIGINT) - 1), least(49, CAST(ceil(run / size) AS BIGINT)) + 1)) AS bucket FROM v2 WHERE n >= 12 AND sd > 0
), v3 AS (
  SELECT market, bucket, share, size, n, greatest(0.0::DOUBLE, least(run, (bucket + 1) * size) - greatest(start, bucket * size)) AS part FROM v2b
), v4 AS (
  SELECT market, bucket, abs(sum(part * (1 - 2 * share))) AS imbalance, sum(part) AS volume, first(size) AS size, first(n) AS n FROM v3 GROUP BY 1, 2
), vpin AS (
  SELECT market, first(n) AS trades, count(*) AS buckets, avg(imbalance / size) AS vpin FROM v4 WHERE volume >= size * (1 - 1e-9) - 1e-9 GROUP BY market HAVING count(*) >= 3)"""
IMPACT = f""", i0 AS (
  SELECT market, t, id, volume, {_LOGIT} AS z FROM series WHERE p > 0 AND p < 1
), i1 AS (
  SELECT *, z - lag(z) OVER (PARTITION BY market ORDER BY t, id) AS dp, row_number() OVER (PARTITION BY market ORDER BY t DESC, id DESC) AS back FROM i0
), i2 AS (SELECT *, sign(dp) * volume AS flow, CASE WHEN volume > 0 AND dp <> 0 THEN abs(dp) / volume END AS ill FROM i1 WHERE dp IS NOT NULL
), i3 AS (SELECT market, count(*) AS bars, regr_slope(dp, flow) AS slope, median(ill) AS mid, median(ill) FILTER (WHERE back <= 3) AS recent FROM i2 GROUP BY market HAVING count(*) >= 5
), impact AS (SELECT market, bars, slope, CASE WHEN mid > 0 THEN coalesce(recent, 0) / mid ELSE 0 END AS ratio FROM i3)"""
_ISCORE = _clip("log2(greatest(1.0::DOUBLE, ratio)) / log2(12.0::DOUBLE)")
RAMP = f""", r0 AS (
  SELECT *, row_number() OVER (PARTITION BY market ORDER BY t, id) AS k, count(*) OVER (PARTITION BY market) AS n FROM series
), r1 AS (SELECT *, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS cut, {_LOGIT2} AS z FROM r0 WHERE n >= 6
), r2 AS (SELECT market, sum(volume) AS total, coalesce(sum(volume) FILTER (WHERE k > cut), 0) AS close, max(n) AS n, max(cut) AS cut, max(z) FILTER (WHERE k = cut + 1) AS z0, max(z) FILTER (WHERE k = n) AS z1 FROM r1 GROUP BY market
), r3 AS (SELECT market, close / total AS close_share, abs(z1 - z0) AS move, CASE WHEN (total - close) / cut > 0 THEN (close / (n - cut)) / ((total - close) / cut) ELSE 1 END AS times FROM r2 WHERE total > 0
), ramp AS (SELECT *, 0.5 * {_clip('close_share / 0.5')} + 0.3 * {_clip('move')} + 0.2 * {_clip('log2(greatest(1.0::DOUBLE, times)) / 3')} AS score FROM r3)"""
MATTERS = """WITH matters AS (
  SELECT 'matter-cl' || (o_orderkey % 9000) AS id, o_orderpriority AS caption, 'p' || (o_custkey % 4) AS platform, 'c' || (o_orderkey % 3) AS contract, o_orderstatus AS forum,
    ['Permitted', 'Enjoined', 'Settled', 'Dismissed', 'Pending'][o_orderkey % 5 + 1] AS outcome, ['Enjoined', 'Pending', 'Permitted', 'Settled', 'Dismissed'][o_custkey % 5 + 1] AS posture, o_custkey % 5 AS rank,
    'g' || (o_orderkey % 7) AS gate, ['S' || (o_custkey % 50), 'S' || (o_orderkey % 50)] AS states, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS filed_date,
    CASE WHEN o_orderkey % 13 = 0 THEN '2020-13-01' WHEN o_orderkey % 17 = 0 THEN '1990-01-01' END AS decided_date
  FROM orders)"""
_REGULATED = "(" + " OR ".join(f"contains(hay, '{w}')" for w in ("united states", "usa", "u.s.a", "cftc", "sec", "gaming commission")) + ")"
DOCKETS = f"""WITH d0 AS (
  SELECT CASE WHEN c_custkey % 29 <> 0 THEN c_custkey * 7 END AS docket_id, c_name || ' v. ' || CASE WHEN c_nationkey % 3 = 0 THEN 'State of X' ELSE 'United States' END AS case_name,
    'nation ' || c_nationkey AS one, CASE WHEN c_custkey % 5 = 0 THEN 'Prediction Market Inc' ELSE 'Other' END AS two, CASE WHEN c_custkey % 2 = 0 THEN '850' ELSE '190' END AS suit,
    CASE WHEN c_custkey % 4 = 0 THEN '2024-01-01' END AS terminated
  FROM customer
), d1 AS (SELECT *, lower(case_name || ' || ' || one || ' || ' || two) AS hay FROM d0
), d2 AS (SELECT *, contains(hay, 'nation 7') AS t7, contains(hay, 'nation 17') AS t17,
    suit = '850' AND {_REGULATED} AND (contains(hay, 'prediction market') OR contains(hay, 'nation 7') OR contains(hay, 'nation 17') OR contains(hay, 'state of ')) AS companion FROM d1
), dockets AS (SELECT *, t7 OR t17 OR companion AS accept, CASE WHEN t7 THEN 'Venue7' WHEN t17 THEN 'Venue17' WHEN companion THEN 'Other' ELSE '' END AS platform,
    CASE WHEN t7 THEN 'target "nation 7" in party' WHEN t17 THEN 'target "nation 17" in party' WHEN companion THEN '850 companion' WHEN suit = '850' THEN 'nature-of-suit 850 without a pairing' ELSE 'no target in caption or parties' END AS reason
  FROM d2)"""
QUEUE = """WITH s AS (
  SELECT user_id AS market, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last, count(*) AS n, CAST(floor(avg(value)) AS BIGINT) AS score FROM events GROUP BY user_id
), p AS (SELECT 'insider' AS engine, market, last - 864000 AS first_seen, last AS last_scanned, CASE WHEN n % 2 = 0 THEN 'Watch' ELSE 'Elevated' END AS tier, score, 'active' AS status FROM s WHERE market % 3 <> 0
), c AS (SELECT 'insider' AS engine, market, CASE WHEN score >= 20 THEN 'Elevated' ELSE 'Watch' END AS tier, score FROM s WHERE market % 2 = 0
), queue AS (
  SELECT coalesce(p.engine, c.engine) AS engine, coalesce(p.market, c.market) AS market, coalesce(p.first_seen, 1709300000) AS first_seen,
    CASE WHEN c.market IS NOT NULL THEN 1709300000 ELSE p.last_scanned END AS last_scanned, coalesce(c.tier, p.tier) AS tier, coalesce(c.score, p.score) AS score,
    CASE WHEN c.market IS NOT NULL THEN 'active' WHEN 1709300000 - p.last_scanned > 1209600 THEN 'retired' ELSE p.status END AS status,
    CASE WHEN p.market IS NULL THEN 'appear' WHEN c.market IS NOT NULL AND p.tier IS DISTINCT FROM c.tier THEN 'tier' WHEN c.market IS NULL AND 1709300000 - p.last_scanned > 1209600 AND p.status <> 'retired' THEN 'retire' ELSE 'same' END AS change
  FROM p FULL JOIN c ON p.engine = c.engine AND p.market = c.market)"""
PAIRS = V + """, f AS (SELECT o_custkey, min(CAST(epoch(o_orderdate) AS BIGINT)) AS first_seen_ts FROM orders GROUP BY 1
), w AS (SELECT 'w' || c_custkey AS wallet, CASE WHEN c_custkey % 20 = 0 THEN 'hub-' || c_nationkey ELSE c_nationkey || '-' || (c_custkey // 100) END AS funder, first_seen_ts FROM customer JOIN f ON c_custkey = o_custkey
), e AS (SELECT wallet, cond // 10 AS event_group, min(ts) AS ts FROM trades WHERE side = 'BUY' GROUP BY 1, 2
), sizes AS (SELECT funder FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 500
), ne AS (SELECT wallet, count(*) AS n FROM e GROUP BY 1
), ab AS (SELECT x.wallet AS a, y.wallet AS b, x.funder, abs(x.first_seen_ts - y.first_seen_ts) AS apart FROM w x JOIN w y USING (funder) JOIN sizes USING (funder) WHERE x.wallet < y.wallet
), sh AS (SELECT a, b, count(*) AS shared, count(*) FILTER (WHERE abs(ea.ts - eb.ts) <= 604800) AS together FROM ab JOIN e ea ON ea.wallet = a JOIN e eb ON eb.wallet = b AND ea.event_group = eb.event_group GROUP BY 1, 2
), pr AS (
  SELECT ab.*, CAST(coalesce(shared, 0) AS INTEGER) AS shared, coalesce(shared / nullif(coalesce(na.n, 0) + coalesce(nb.n, 0) - shared, 0), 0) AS co_spend, coalesce(together / shared, 0) AS sync,
    CASE WHEN apart <= 5184000 THEN 1 - apart / 5184000 ELSE 0 END AS near
  FROM ab LEFT JOIN sh USING (a, b) LEFT JOIN ne na ON na.wallet = a LEFT JOIN ne nb ON nb.wallet = b
), pairs AS (SELECT *, least(1.0, 0.4 + 0.25 * co_spend + 0.2 * sync + 0.15 * near) AS link, CASE WHEN 0.4 >= greatest(0.2 * sync, 0.15 * near) THEN 'fund' WHEN 0.2 * sync >= 0.15 * near THEN 'sync' ELSE 'create' END AS type FROM pr)"""
WATCH = FUSED + f""", flagged AS (SELECT wallet FROM (SELECT wallet, {_TIER} AS tier FROM fused) WHERE tier IN ('high', 'extreme', 'notable')
), peer AS (SELECT cond, count(*) AS n, sum(usd) AS total, sum(usd * usd) AS squares, list_sort(list(usd))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p90 FROM trades GROUP BY cond
), firsts AS (SELECT wallet, arg_min(tx, ts * 1000000000 + tx) AS first_tx FROM trades GROUP BY wallet
), w0 AS (
  SELECT t.cond, t.wallet, t.tx, t.usd, t.price, n - 1 AS m, total - usd AS rest, squares - usd * usd AS rest2, total, p90, f.wallet IS NOT NULL AS repeat, first_tx = t.tx AS fresh
  FROM trades t JOIN peer USING (cond) JOIN firsts USING (wallet) LEFT JOIN flagged f ON f.wallet = t.wallet WHERE usd >= 1000
), w1 AS (SELECT *, sqrt(greatest(0.0, (rest2 - m * (rest / nullif(m, 0)) * (rest / nullif(m, 0))) / CASE WHEN m > 1 THEN m - 1 END)) AS sd FROM w0
), w2 AS (
  SELECT *, coalesce(CASE WHEN sd > 0 THEN (usd - rest / nullif(m, 0)) / sd END, 0.0) AS size_z, CASE WHEN p90 > 0 THEN usd / p90 ELSE 0 END AS whale_x, usd / total AS vol_share,
    CAST(CASE WHEN least(price, 1.0) < 0.85 THEN floor(35 * (0.85::DOUBLE - least(price, 1.0::DOUBLE)) / 0.85::DOUBLE + 0.5) ELSE floor(-25 * (least(price, 1.0::DOUBLE) - 0.85::DOUBLE) / 0.15::DOUBLE + 0.5) END AS INTEGER) AS conviction
  FROM w1
), w3 AS (SELECT *, usd >= 25000 OR (vol_share >= 0.08 AND usd >= 5000) OR (m >= 6 AND (size_z >= 3 OR whale_x >= 10) AND usd >= 5000) AS outsized FROM w2
), w4 AS (SELECT *, 20 * outsized::INTEGER + conviction + 30 * repeat::INTEGER + 15 * fresh::INTEGER AS raw FROM w3
), watch AS (SELECT *, greatest(0, CASE WHEN price >= 0.95 THEN least(15, raw) ELSE raw END) AS score FROM w4)"""

_CONTEXT = FUSED + f""", cx AS (
  SELECT f.*, {_TIER} AS tier, r.* EXCLUDE (wallet), coalesce(f.p <= 0.01, false) AS improbable, cheap_weighted / nullif(cheap_stake, 0) AS odds FROM fused f JOIN records r USING (wallet)
), cy AS (
  SELECT *, CASE WHEN p IS NOT NULL THEN ls_groups ELSE ls_bets END AS shown_n, ls_won AS shown_k, floor(100 * coalesce(CASE WHEN p IS NOT NULL THEN ls_p END, odds, ls_mean, 0) + 0.5) AS implied, coalesce(ls_pnl, 0) AS profit,
    CASE WHEN improbable THEN floor(1 / greatest(p, 1e-15) + 0.5) WHEN odds > 0 THEN floor(1 / odds + 0.5) ELSE 0 END AS denominator, CASE tier WHEN 'extreme' THEN 'extreme' WHEN 'high' THEN 'elevated' WHEN 'notable' THEN 'watch' END AS t0 FROM cx
), cz AS (SELECT *, CASE WHEN shown_n > 0 THEN floor(100 * ls_won / shown_n + 0.5) ELSE 0 END AS rate, CASE WHEN t0 = 'extreme' AND profit > 0 AND profit < 25000 THEN 'elevated' ELSE t0 END AS t1 FROM cy
), context AS (SELECT *, CASE WHEN t1 IN ('extreme', 'elevated') AND profit > 0 AND profit < 10000 THEN 'watch' ELSE t1 END AS shown_tier, ',' || fired || ',' AS f2 FROM cz
), gated AS (
  SELECT *, coalesce(shown_tier IS NOT NULL AND (improbable OR conv) AND greatest(ls_staked, coalesce(cheap_stake, 0)) >= CASE WHEN tier IN ('extreme', 'high') THEN 1250 ELSE 2500 END, false) AS considered,
    CASE WHEN shown_tier IS NULL THEN 'no tier' WHEN NOT shown_n >= 1 THEN 'n<1' WHEN NOT shown_k BETWEEN 0 AND shown_n THEN 'k out of range' WHEN NOT implied BETWEEN 1 AND 99 THEN 'avgImplied out of range'
      WHEN NOT rate BETWEEN 0 AND 100 THEN 'winRate out of range' WHEN NOT denominator >= 1 THEN 'improbDenom invalid' WHEN profit <= 0 THEN 'net unprofitable' WHEN account_pnl <= 0 THEN 'account net-negative'
      WHEN profit < 2500 THEN 'below net-profit floor' WHEN bad_entries > 0 THEN 'bad entryPrice' WHEN NOT improbable AND NOT (conv AND cheap_stake > 0) THEN 'convOnly without a valid conviction bet' END AS reject_reason,
    0.40::DOUBLE * coalesce(least(1.0::DOUBLE, -log10(greatest(coalesce(p, pc), 1e-15)) / 12), 0) + 0.28::DOUBLE * least(1.0::DOUBLE, n_fired / 9) + 0.08::DOUBLE * (contains(f2, ',timing,') OR contains(f2, ',crossCat,'))::INT
      + 0.12::DOUBLE * least(1.0::DOUBLE, log10(greatest(abs(profit), 1.0)) / 6) + 0.12::DOUBLE * (contains(f2, ',conceal,') OR contains(f2, ',cluster,') OR (contains(f2, ',conviction,') AND contains(f2, ',concentration,')))::INT AS raw FROM context
), scored AS (SELECT *, floor(raw * 1000 + 0.5 + 1e-7) / 10 AS suspicion FROM gated
), eps AS (
  SELECT wallet, cond, s, pnl AS profit, CASE WHEN s >= 1110 THEN 'extreme' WHEN s >= 810 THEN 'high' WHEN s >= 530 THEN 'notable' END AS tier FROM (
    SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY s DESC, cond) AS r FROM (
      SELECT b.*, 30 * z_profit + 25 * z_bet + 20 * CASE WHEN sd > 0 THEN (stake - m) / sd ELSE 0 END + 15 * late + 10 * directional AS s, CASE WHEN sd > 0 THEN (stake - m) / sd ELSE 0 END AS zw
      FROM bets b LEFT JOIN (SELECT wallet, avg(stake) AS m, stddev_samp(stake) AS sd FROM bets WHERE stake > 0 GROUP BY wallet) USING (wallet) WHERE z_bet IS NOT NULL AND pnl >= 250 AND entry <= 0.9) WHERE (z_bet > 2 OR zw > 2) AND won AND z_profit > 0) WHERE r = 1
), favb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY z_profit DESC, cond) AS r FROM bets WHERE z_profit >= 2) WHERE r = 1
), fav AS (
  SELECT wallet, CASE WHEN b.pnl >= 10000 THEN CASE WHEN b.z_profit >= 4 AND st >= 2 THEN 'extreme' WHEN b.z_profit >= 3 OR st >= 2 THEN 'elevated' ELSE 'watch' END ELSE 'watch' END AS tier, x.pnl AS profit, b.z_profit AS measure
  FROM (SELECT *, contains(f2, ',conceal,')::INT + contains(f2, ',cluster,')::INT AS st FROM context) x JOIN favb b USING (wallet)
  WHERE b.won AND b.entry > 0 AND b.entry <= 0.9 AND (b.z_bet >= 2 OR contains(f2, ',sizing,')) AND greatest(b.stake, abs(b.pnl)) >= 2500 AND x.pnl >= 5000 AND st >= 1 AND account_pnl >= 1000
), cro AS (
  SELECT x.wallet, CASE WHEN pc <= 0.0001 THEN 'elevated' ELSE 'watch' END AS tier, pnl AS profit, pc AS measure FROM context x
  JOIN (SELECT wallet, count(*) AS agree FROM long WHERE fires AND score >= 0.45 AND detector <> 'crossCat' GROUP BY wallet) USING (wallet)
  WHERE contains(f2, ',crossCat,') AND agree >= 2 AND pnl >= 2500 AND greatest(staked, max_event) >= 2500 AND (account_pnl IS NULL OR account_pnl > 0)
), epi AS (
  SELECT wallet, CASE e.tier WHEN 'extreme' THEN 'extreme' ELSE 'elevated' END AS tier, e.profit, e.s AS measure FROM eps e JOIN records USING (wallet)
  WHERE e.tier IN ('high', 'extreme') AND account_pnl >= 1000 AND e.profit >= 1000 AND e.profit <= greatest(50000.0, 5 * account_pnl)
), every AS (
  SELECT wallet, 0 AS rank, 'record' AS pass, shown_tier AS tier, profit, denominator AS measure FROM gated WHERE considered AND reject_reason IS NULL
  UNION ALL SELECT wallet, 1, 'favourite', tier, profit, measure FROM fav UNION ALL SELECT wallet, 2, 'cross', tier, profit, measure FROM cro UNION ALL SELECT wallet, 3, 'episode', tier, profit, measure FROM epi
), published AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY rank) AS r FROM every) WHERE r = 1)"""
_CARD_SQL = " ".join(f"WHEN '{k}' THEN printf('{m[1]}', measure + 1e-7)" for k, m in CARDS.items())
_METHOD_SQL = " ".join(f"WHEN '{k}' THEN '{m[0].replace(chr(39), chr(39) * 2)}'" for k, m in CARDS.items())
_EVERY_DETECTOR = " UNION ALL ".join(f"SELECT wallet, '{k}' AS detector, fires, score, measure FROM ({_detector(k)})" for k in DETECTORS)
_ASKED = "(SELECT wallet FROM records ORDER BY pnl DESC, wallet LIMIT 25)"
_PUBLISHED = {
    "publish_gate": f"{_CONTEXT} SELECT wallet, tier, shown_tier, considered, reject_reason, round(suspicion, 1) AS suspicion, CASE WHEN suspicion >= 45 AND profit >= 10000 THEN 'elevated' ELSE 'watch' END AS final_tier FROM scored",
    "publish_passes": f"{_CONTEXT} SELECT wallet, pass, tier, {_r('profit', 'measure')} FROM published",
    "rejected_wallets": f"{_CONTEXT} SELECT wallet, tier, reject_reason FROM gated WHERE considered AND reject_reason IS NOT NULL ORDER BY wallet LIMIT 500",
    "scorecard": f"{RECORDS} SELECT wallet, detector, CASE detector {_METHOD_SQL} END AS method, CASE detector {_CARD_SQL} END AS metric FROM ({_EVERY_DETECTOR}) WHERE fires",
    "ledger": f"{BETS} SELECT wallet, r AS place, cond, floor(100 * entry + 0.5)::BIGINT AS odds, {_r('stake')}, round(pnl + 0.0000001, 3) AS profit, won FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY stake DESC, cond) AS r FROM bets) WHERE r <= 14",
    "feed_by_suspicion": f"{_CONTEXT} SELECT wallet, shown_tier AS tier, round(suspicion, 1) AS suspicion, denominator::BIGINT AS denominator FROM scored WHERE considered AND reject_reason IS NULL ORDER BY scored.suspicion DESC, scored.denominator DESC, wallet LIMIT 100",
    "subject_report": f"{_CONTEXT}, asked AS {_ASKED} SELECT wallet, tier, fired, bets, wins, {_r('pnl', 'mean_odds')}, reject_reason FROM gated SEMI JOIN asked USING (wallet)",
    "wallet_report": f"""{_CONTEXT}, led AS (SELECT wallet, r AS place, cond, floor(100 * entry + 0.5)::BIGINT AS odds, stake, pnl AS profit, won FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY stake DESC, cond) AS r FROM bets) WHERE r <= 200)
      SELECT wallet, tier, fired, reject_reason, place, cond, odds, {_r('stake')}, round(profit + 0.0000001, 3) AS profit, led.won FROM led JOIN (SELECT wallet, tier, fired, reject_reason FROM gated) USING (wallet) WHERE wallet IN (SELECT 'w' || c_custkey FROM customer WHERE c_nationkey = 7)""",
    "calibration": f"{_CONTEXT}, asked AS {_ASKED} SELECT wallet, detector, fires, {_r('score', 'measure')}, wallet IN (SELECT wallet FROM published) AS published FROM ({_EVERY_DETECTOR}) SEMI JOIN asked USING (wallet)",
    "info_signals": f"""{_CONTEXT}, nb AS (SELECT wallet FROM ({_detector('newsBlackout')}) WHERE fires), y AS (SELECT g.*, n.wallet IS NOT NULL AS quiet FROM gated g LEFT JOIN nb n USING (wallet))
      SELECT wallet, n_fired + quiet::INT AS n_fired, round(floor((raw + 0.28::DOUBLE * (least(1.0::DOUBLE, (n_fired + quiet::INT) / 9) - least(1.0::DOUBLE, n_fired / 9)) + CASE WHEN quiet AND NOT (contains(f2, ',timing,') OR contains(f2, ',crossCat,')) THEN 0.08::DOUBLE ELSE 0 END) * 1000 + 0.5 + 1e-7) / 10, 1) AS suspicion FROM y""",
    "cheap_screen": f"{BETS} SELECT wallet, cond, {_r('stake', 'entry')} FROM bets WHERE (won AND entry <= 0.35) OR z_bet > 2 OR (stake >= 2500 AND entry <= 0.35)",
    "dominant_category": f"{BETS} SELECT wallet, category, n FROM (SELECT wallet, category, count(*) AS n, row_number() OVER (PARTITION BY wallet ORDER BY count(*) DESC, category) AS r FROM bets GROUP BY wallet, category) WHERE r = 1",
    "shadow_overlap": f"{_CONTEXT} SELECT tier, count(*) AS n, count(*) FILTER (WHERE wallet IN (SELECT wallet FROM published)) AS published, count(*) FILTER (WHERE wallet NOT IN (SELECT wallet FROM published)) AS only_shadow FROM (SELECT wallet, coalesce(tier, 'below') AS tier FROM eps) GROUP BY tier",
    "episode_percentile": f"{_CONTEXT}, e AS (SELECT wallet, round(s, 2) AS s FROM eps) SELECT wallet, s, round(CASE WHEN count(*) OVER () > 1 THEN 100 * (count(*) OVER () - rank() OVER (ORDER BY s DESC)) / (count(*) OVER () - 1) ELSE 99.9 END + 1e-7, 3) AS percentile FROM e",
    "category_coverage": f"{V}, w AS (SELECT DISTINCT cond FROM trades) SELECT category, count(*) AS markets FROM catalog SEMI JOIN w USING (cond) GROUP BY category",
    "entities": f"{V}, {sql_entities('listings', 'named2', 'market')} SELECT market, array_to_string(ents, '; ') AS entities, corr AS corr_key FROM named2",
    "market_category": f"{V}, l AS (SELECT market, question, lower(array_to_string(tags, ' ') || ' ' || question) AS t, lower(question) AS q FROM listings) SELECT market, nullif(CASE {_rules(CATEGORY_RULES, 't')} ELSE '' END, '') AS category, CASE {_rules(FALLBACK_RULES, 'q')} ELSE 'Other' END AS fallback FROM l",
    "market_taxonomy": f"""{V}, l AS (SELECT market, question, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM listings), k AS (SELECT market, i, CASE {_rules(TAXONOMY_RULES, 'lower(tag)')} END AS kind FROM l
      ), m AS (SELECT market, arg_min(kind, i) FILTER (WHERE kind NOT IN {EXCLUDED}) AS detectable, count(kind) AS kinds FROM k GROUP BY market), a AS (SELECT market, CASE {_rules(TAXONOMY_RULES, 'lower(question)')} END AS asked FROM listings)
      SELECT market, CASE WHEN detectable IS NOT NULL THEN detectable WHEN kinds > 0 THEN NULL WHEN asked NOT IN {EXCLUDED} THEN asked END AS kind FROM m JOIN a USING (market)""",
    "scope_drop": f"""{V}, l AS (SELECT market, lower(array_to_string(tags, ' ') || ' ' || question) AS t, lower(question) AS q FROM listings), c AS (SELECT market, coalesce(nullif(CASE {_rules(CATEGORY_RULES, 't')} ELSE '' END, ''), CASE {_rules(FALLBACK_RULES, 'q')} ELSE 'Other' END) AS category FROM l)
      SELECT count(*) FILTER (WHERE category NOT IN ('Sports', 'Crypto', 'Weather', 'Other')) AS kept, count(*) FILTER (WHERE category IN ('Sports', 'Crypto', 'Weather', 'Other')) AS dropped FROM c""",
    "texts": f"""{V} SELECT market, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(question, '[?]+', ' ', 'g')), '^(will|does|is|are|can|did|has|have|the|a|an)\\s+', '', 'i'),
        '\\s+(by|in|before|on|this|next)\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|q[1-4]|20[0-9][0-9]|[0-9]).*$', '', 'i'), '\\s+', ' ', 'g')) AS query,
        '$' || CASE WHEN v >= 1e6 THEN regexp_replace(printf('%.1f', floor(v / 1e6 * 10 + 0.5) / 10), '\\.0$', '') || 'M' WHEN v >= 1e3 THEN floor(v / 1e3 + 0.5)::BIGINT || 'K' ELSE v::BIGINT::VARCHAR END AS volume_text,
        '1 in ' || CASE WHEN d >= 1e6 THEN regexp_replace(printf('%.1f', floor(d / 1e6 * 10 + 0.5) / 10), '\\.0$', '') || 'M' WHEN d >= 1e3 THEN regexp_replace(printf('%.1f', floor(d / 1e3 * 10 + 0.5) / 10), '\\.0$', '') || 'K' ELSE d::BIGINT::VARCHAR END AS odds_text,
        CASE WHEN p < 1e-6 THEN 'p < 1e-6' WHEN p < 1e-4 THEN 'p < 1e-4' WHEN p < 0.001 THEN 'p < 0.001' WHEN p < 0.01 THEN 'p < 0.01' WHEN p < 0.05 THEN 'p < 0.05' ELSE printf('p = %.2f (not significant)', p) END AS p_text,
        strftime(make_timestamp((1700000000 + market * 7777) * 1000000), '%b %d %Y') AS day
      FROM (SELECT *, floor(volume * (1 + market % 2000) + 0.5) AS v, 1 / (1 + market * 1.0::DOUBLE * market) AS p, floor(1 / (1 / (1 + market * 1.0::DOUBLE * market)) + 0.5) AS d FROM listings)""",
}


_LOOK = lambda key, values: f"CASE lower({key}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items() if k) + f" ELSE {values['']} END"
_LEVELS = """levels AS MATERIALIZED (SELECT l_partkey % 200 AS market, l_linestatus = 'O' AS up, 0.03::DOUBLE + ((l_orderkey * 7 + l_linenumber * 13) % 45)::DOUBLE / 100 AS low, l_orderkey % 2 = 0 AS cents, l_quantity AS size FROM lineitem
), book0 AS (SELECT market, coalesce(max(CASE WHEN up THEN low END), 0) AS best_bid, coalesce(min(CASE WHEN NOT up THEN low + 0.48::DOUBLE END), 1) AS best_ask, coalesce(sum(CASE WHEN up THEN low * size END), 0) AS bids, coalesce(sum(CASE WHEN NOT up THEN (low + 0.48::DOUBLE) * size END), 0) AS asks FROM levels GROUP BY market
), book AS (SELECT market, best_bid, best_ask, greatest(0.0::DOUBLE, best_ask - best_bid) AS spread, bids + asks AS depth, CASE WHEN bids + asks > 0 THEN (bids - asks) / (bids + asks) ELSE 0 END AS imbalance FROM book0)"""
_QUERY = lambda q: f"trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace({q}, '[?]+', ' ', 'g')), '^(will|does|is|are|can|did|has|have|the|a|an)\\s+', '', 'i'), '\\s+(by|in|before|on|this|next)\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|q[1-4]|20[0-9][0-9]|[0-9]).*$', '', 'i'), '\\s+', ' ', 'g'))"
_W4 = lambda t: f"list_distinct(list_filter(string_split_regex(lower({t}), '[^a-z0-9_]+'), lambda w: length(w) >= 4))"
NEWS = BETS + f""", {_LEVELS}, moves AS (SELECT c.cond, c.cond AS market, {_QUERY('question')} AS query, coalesce(shock_ts, resolved_ts) AS move_ts FROM catalog c LEFT JOIN shock s USING (cond)
), told AS (SELECT o_orderkey AS item, {sql_question('o_orderkey')} AS title, ['Reuters wire', 'x.com post', 'daily blog'][o_orderkey % 3 + 1] AS source, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders
), aw AS (SELECT market, move_ts, CASE WHEN len({_W4('query')}) >= 3 THEN 2 ELSE 1 END AS need, unnest({_W4('query')}) AS word FROM moves
), tw AS (SELECT item, source, ts, unnest({_W4('title')}) AS word FROM told
), hits AS (SELECT market, item, source, ts, move_ts, need, count(*) AS hits FROM aw JOIN tw USING (word) WHERE ts BETWEEN move_ts - 172800 AND move_ts + 1900800 GROUP BY ALL
), rel AS (SELECT *, ts - move_ts AS late FROM hits WHERE hits >= need
), pick AS (SELECT *, CASE WHEN late BETWEEN -172800 AND 129600 THEN 0 WHEN late > 129600 AND floor(late / 3600.0::DOUBLE + 0.5) <= 504 THEN 1 END AS kind FROM rel
), news0 AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY kind, ts, source) AS r FROM pick WHERE kind IS NOT NULL
), news1 AS (SELECT market, ts, source, kind = 1 AS pre_event, CAST(CASE WHEN kind = 0 THEN greatest(0.0::DOUBLE, (move_ts - ts) / 3600.0::DOUBLE) ELSE floor((ts - move_ts) / 3600.0::DOUBLE + 0.5) END AS DOUBLE) AS hours FROM news0 WHERE r = 1
), news AS (SELECT *, CASE WHEN pre_event THEN 0.0 ELSE {_clip("CASE WHEN source = 'Reuters wire' THEN 1.0 WHEN source = 'x.com post' THEN 0.4 ELSE 0.7 END * " + _clip('1 - abs(hours) / 48'))} END AS explained FROM news1)"""
_LSB = f"({_LOOK('category', BASELINE)})"
SCREENS = NEWS + f""", ls0 AS (SELECT cond, wallet, CASE WHEN stake >= 2500 AND entry <= 0.35 THEN CASE WHEN cond % 7 = 0 THEN {_clip('(0.35 - entry) / 0.35 * 0.4', 0, 0.5)}
    WHEN won THEN {_clip('0.45 + 0.4 * ' + _clip('1 - entry') + ' + 0.15 * ' + _clip(f'({_LSB} - entry) / greatest(0.05, {_LSB})'))} ELSE 0.1 END ELSE 0 END AS sub FROM positions
), vol AS (SELECT cond, wallet, coalesce(sum(usd) FILTER (WHERE side <> 'SELL'), 0) AS buy_usd, coalesce(sum(usd) FILTER (WHERE side = 'SELL'), 0) AS sell_usd, min(ts) FILTER (WHERE side <> 'SELL') AS first_ts FROM trades GROUP BY cond, wallet
), acc0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY buy_usd DESC, wallet DESC) AS r FROM vol WHERE buy_usd > 0) WHERE r = 1
), acc AS (SELECT a.cond, a.wallet, {_clip(f"0.45 * {_clip('log10(greatest(1.0, abs(buy_usd - sell_usd))) / 5')} + 0.30 * CASE WHEN sell_usd / buy_usd <= 0.03 THEN 1.0 ELSE {_clip('1 - sell_usd / buy_usd / 0.2')} END + 0.25 * CASE WHEN p.won IS NULL THEN 0.5 WHEN p.won THEN 1.0 ELSE 0.0 END")} AS sub FROM acc0 a LEFT JOIN positions p USING (cond, wallet)
), con0 AS (SELECT cond, sum(buy_usd) AS total, sum(buy_usd * buy_usd) AS sq, max(buy_usd) AS top, arg_max(first_ts, buy_usd) AS came, count(*) AS n FROM vol WHERE buy_usd > 0 GROUP BY cond HAVING count(*) >= 3)"""
_CON = lambda moves, hours: f"""con AS (SELECT cond, sq / (total * total) AS hhi, top / total AS top, coalesce(move_ts - came <= {hours * 3600} AND move_ts - came >= -3600, false) AS fresh FROM con0 LEFT JOIN {moves} USING (cond)
), cons AS (SELECT *, {_clip('0.55 * hhi + 0.45 * top + CASE WHEN fresh THEN 0.15 ELSE 0.0 END')} AS score FROM con)"""  # noqa: E731
_LIQ = lambda v, d: f"(0.4 * {_clip(f'(log10(greatest({v}, 1.0)) - 3) / 3')} + 0.3 * coalesce({_clip('1 - spread / 0.1')}, 0.5) + 0.2 * coalesce({_clip(f'(log10(greatest({d}, 1.0)) - 2) / 3')}, 0) + 0.1 * {_clip('log10(greatest(n, 1)) / 3')})"


def _engine(name: str, parts: str, factor: str, news: bool) -> str:
    told, joined = ("coalesce(n2.explained, 0) AS explained, coalesce(n2.pre_event, true) AS pre_event", "LEFT JOIN news n2 ON n2.market = c.cond") if news else ("0 AS explained, NULL AS pre_event", "")
    return f""", eng0 AS MATERIALIZED ({parts}
    ), facts AS MATERIALIZED (SELECT c.cond AS market, c.cond % 2 = 1 AS anonymous, {_LIQ('volume', 'depth')} AS quality, {told}, {_LOOK('category', MULTIPLIER)}::DOUBLE AS multiplier
      FROM catalog c JOIN (SELECT cond, sum(usd) AS volume, count(*) AS n FROM trades GROUP BY cond) z USING (cond) LEFT JOIN book b ON b.market = c.cond {joined}
    ), eng1 AS MATERIALIZED (SELECT market, sum(w * sub) / sum(w) AS raw, count(*) AS ran, count(*) FILTER (WHERE sub >= 0.45) AS agreeing, any_value(anonymous) AS anonymous, any_value(quality) AS quality, any_value(explained) AS explained, any_value(pre_event) AS pre_event, any_value(multiplier) AS multiplier
      FROM eng0 JOIN facts USING (market) WHERE sub IS NOT NULL AND NOT (anonymous AND wallets) GROUP BY market
    ), eng2 AS (SELECT *, CASE WHEN anonymous THEN 3 ELSE 4 END AS total FROM eng1
    ), eng3 AS (SELECT *, CAST(floor(100 * {_clip(f'raw * {factor}')} * ran / total + 0.5 + 1e-9) AS INTEGER) AS score FROM eng2
    ), {name} AS (SELECT market, raw, ran, total, score, agreeing, CASE WHEN quality <= 0.25 THEN 'Watch' WHEN ran = total AND agreeing >= 2 AND score >= 70 THEN 'High-signal' WHEN score >= 50 AND agreeing >= 1 THEN 'Elevated' WHEN score >= 30 THEN 'Watch' ELSE 'Clear' END AS tier,
      CASE WHEN quality <= 0.25 THEN 'Low-liquidity artifact' WHEN explained >= 0.5 AND NOT coalesce(pre_event, false) THEN 'Explained' WHEN raw >= 0.5 AND explained < 0.3 THEN 'Unexplained' ELSE 'Partially explained' END AS label FROM eng3)"""


_RUN_UP_ONLY = RUN_UP.split(", z AS (", 1)[1]
_ENGINE_INSIDER = SCREENS + ", z AS (" + _RUN_UP_ONLY + ", " + _CON("moves", 48) + _engine("engine", "SELECT market, 0.30::DOUBLE AS w, score AS sub, false AS wallets FROM run_up UNION ALL SELECT cond, 0.25, sub, false FROM acc UNION ALL SELECT cond, 0.25, score, false FROM cons UNION ALL SELECT cond, 0.20, max(sub), true FROM ls0 GROUP BY cond", _clip("(1 - 0.6 * explained) * multiplier", 0, 1.5), True)
_ENGINE_MANIPULATION = V + ", " + _LEVELS + RAMP.replace("WITH", "") + IMPACT + VPIN + ", vol AS (SELECT cond, wallet, coalesce(sum(usd) FILTER (WHERE side <> 'SELL'), 0) AS buy_usd, coalesce(sum(usd) FILTER (WHERE side = 'SELL'), 0) AS sell_usd FROM trades GROUP BY cond, wallet)" + _engine("engine", f"""SELECT market, 0.25::DOUBLE AS w, score AS sub, false AS wallets FROM ramp UNION ALL SELECT market, 0.25, {_ISCORE}, false FROM impact UNION ALL SELECT market, 0.20, vpin, false FROM vpin
      UNION ALL SELECT cond, 0.30, {_clip('0.7 * 2 * sum(least(buy_usd, sell_usd)) / sum(buy_usd + sell_usd)')}, true FROM vol GROUP BY cond""", "1.0", False)
_SCORED = _ENGINE_MANIPULATION + ", scored AS MATERIALIZED (SELECT market, score, tier, market % 4 = 0 AS resolved, CASE WHEN market % 2 = 1 THEN 'anonymous' ELSE 'wallets' END AS venue FROM engine)"
_SURVEILLANCE = {
    "order_book": f"WITH {_LEVELS} SELECT market, {_r('best_bid', 'best_ask', 'spread', 'depth', 'imbalance', digits=4)} FROM book",
    "two_sided_book": f"""WITH {_LEVELS}, y AS (SELECT market, up, CASE WHEN cents AND 100 * low > 1 THEN (100 * low) / 100 ELSE low END AS price, size FROM levels
      ), z AS (SELECT market, coalesce(max(CASE WHEN up THEN price END), 0) AS best_bid, coalesce(max(CASE WHEN NOT up THEN price END), 0) AS no, sum(CASE WHEN up THEN price * size ELSE 0 END) AS bids, sum(CASE WHEN NOT up THEN price * size ELSE 0 END) AS asks FROM y GROUP BY market
      ), q AS (SELECT market, best_bid, 1 - no AS best_ask, greatest(0.0::DOUBLE, 1 - best_bid - no) AS spread, bids + asks AS depth, (bids - asks) / (bids + asks) AS imbalance FROM z WHERE bids + asks > 0) SELECT market, {_r('best_bid', 'best_ask', 'spread', 'depth', 'imbalance', digits=4)} FROM q""",
    "venue_markets": f"""WITH q AS (SELECT p_partkey AS market, CASE WHEN p_partkey % 3 = 0 AND p_size > 0 THEN CASE WHEN p_size > 1 THEN p_size / 100 ELSE p_size END ELSE (p_size / 100 + p_size / 100 + 0.04::DOUBLE) / 2 END AS prob FROM part) SELECT market, {_r('prob', digits=4)} FROM q WHERE q.prob BETWEEN 0.02 AND 0.98""",
    "news_gap": f"{NEWS} SELECT market, ts, source, pre_event, {_r('hours', 'explained', digits=4)} FROM news",
    "longshot_screen": f"{SCREENS} SELECT cond, wallet, {_r('sub', digits=4)} FROM ls0 WHERE ls0.sub > 0",
    "accumulation": f"{SCREENS} SELECT cond, wallet, {_r('sub', digits=4)} FROM acc",
    "volume_run_up": f"""{V}, k AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY t, id) AS k, count(*) OVER (PARTITION BY market) AS n FROM series), h AS (SELECT market, avg(volume) FILTER (WHERE k <= n // 2) AS base, avg(volume) FILTER (WHERE k > n // 2) AS pre FROM k GROUP BY market)
      SELECT market, {_r('base', 'pre', digits=4)}, round(h.pre / h.base + 1e-7, 4) AS ratio, round({_clip('log2(greatest(1.0::DOUBLE, h.pre / h.base)) / log2(10.0::DOUBLE)')} + 1e-7, 4) AS score FROM h WHERE h.base > 0""",
    "proxy_run_up": f"""{V}, e AS (SELECT market, arg_max(p, (t, id)) AS p1, arg_min(p, (t, id)) AS p0 FROM series GROUP BY market), l AS (SELECT market, greatest(0.001::DOUBLE, least(0.999::DOUBLE, p1)) AS a, greatest(0.001::DOUBLE, least(0.999::DOUBLE, p1 - (p1 - p0))) AS b FROM e)
      SELECT market, round({_clip('abs(ln(a / (1 - a)) - ln(b / (1 - b))) / 0.55 / 4')} + 1e-7, 4) AS score FROM l""",
    "top_concentration": f"{SCREENS}, mv AS (SELECT cond, shock_ts AS move_ts FROM shock), {_CON('mv', 24 * 365)} SELECT cond, fresh, {_r('hhi', 'top', 'score', digits=4)} FROM cons",
    "trimmed_series": f"""{V}, s AS (SELECT market, t, id, CASE WHEN p > 0.6 THEN 0.995 ELSE p END AS p FROM series), e AS (SELECT *, last_value(p) OVER (PARTITION BY market ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM s
      ), l AS (SELECT *, max(CASE WHEN abs(p - round(fin)) > 0.01 THEN t END) OVER (PARTITION BY market) AS last FROM e), k AS (SELECT * FROM l WHERE NOT (least(fin, 1 - fin) <= 0.01) OR t <= last
      ), d AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY t, id) - 1 AS k, count(*) OVER (PARTITION BY market) AS n FROM k) SELECT market, count(*) AS n, count(*) FILTER (WHERE k % greatest(1, n // 10) = 0) AS sampled FROM d GROUP BY market""",
    "engine_insider": f"{_ENGINE_INSIDER} SELECT market, {_r('raw', digits=4)}, ran, total, score, agreeing, tier, label FROM engine",
    "engine_manipulation": f"{_ENGINE_MANIPULATION} SELECT market, {_r('raw', digits=4)}, ran, total, score, agreeing, tier, label FROM engine",
    "market_quality": f"{NEWS}, z AS (SELECT cond AS market, sum(usd) AS volume, count(*) AS n FROM trades GROUP BY cond) SELECT market, round({_LIQ('volume / 1000', 'depth / 100')} + 1e-7, 4) AS quality FROM z LEFT JOIN book USING (market)",
    "deep_set": f"""{_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY resolved ORDER BY score DESC, market) AS r, row_number() OVER (PARTITION BY resolved, venue ORDER BY score DESC, market) AS v FROM scored)
      SELECT market, score, tier, resolved, venue FROM r WHERE (resolved AND r <= 8) OR (NOT resolved AND v <= 7) ORDER BY resolved DESC, score DESC, market LIMIT 22""",
    "feed_coverage": f"{_SCORED} SELECT venue, tier, count(*) AS n, count(*) FILTER (WHERE tier IN ('High-signal', 'Elevated')) AS alerts FROM scored GROUP BY venue, tier",
    "augmented_set": "SELECT p_partkey AS market, p_retailprice AS volume FROM part WHERE p_retailprice > 900.5",
    "top_markets_of_event": f"{V}, v AS (SELECT cond, cond // 10 AS event_group, round(sum(usd), 2) AS volume FROM trades GROUP BY cond) SELECT cond, event_group, volume FROM (SELECT *, row_number() OVER (PARTITION BY event_group ORDER BY volume DESC, cond) AS r FROM v) WHERE r <= 4",
}


_P = "(0.05::DOUBLE + 0.9::DOUBLE * value / (value + 20))"
_WP = f"(CASE WHEN {_P} < 0.85 THEN floor(35 * (0.85::DOUBLE - {_P}) / 0.85::DOUBLE + 0.5) ELSE floor(-25 * ({_P} - 0.85::DOUBLE) / 0.15::DOUBLE + 0.5) END + CASE WHEN value >= 100 THEN 20 ELSE 0 END + CASE WHEN event_type = 'error' THEN 35 ELSE 0 END)"
_RINGS = PAIRS + """, bet AS (SELECT funder, wallet FROM w SEMI JOIN e USING (wallet)), sz AS (SELECT funder, count(DISTINCT wallet) AS members FROM bet GROUP BY funder
), pg AS (SELECT funder, count(*) AS edges, avg(link) AS mean_link, max(link) AS best, max(co_spend) AS c, max(sync) AS s, max(near) AS n FROM pairs GROUP BY funder
), rings AS (SELECT funder, members, edges, mean_link, best FROM sz JOIN pg USING (funder) WHERE members >= 2 AND (members >= 3 OR c >= 0.05 OR s >= 0.3 OR n >= 0.5))"""
_TRANSFERS = "t AS (SELECT o_orderkey % 400 AS f, o_custkey % 700 AS t, o_totalprice AS value, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders)"
_FULL = """fd AS (SELECT c_custkey AS k, c_custkey * 7 AS docket_id, c_name || ' v. ' || CASE c_nationkey % 3 WHEN 0 THEN 'State of X' WHEN 1 THEN 'Van Dyke' ELSE 'Kalshi traders' END AS name, c_name || ' v. ' || CASE c_nationkey % 3 WHEN 0 THEN 'State Of X' WHEN 1 THEN 'Van Dyke' ELSE 'Kalshi Traders' END AS titled,
    'court' || c_nationkey AS court_id, CASE WHEN c_custkey % 4 = 0 THEN 'Venue' ELSE '' END AS platform, CASE WHEN c_custkey % 5 <> 0 THEN '2024-03-01' END AS filed, CASE WHEN c_custkey % 7 = 0 THEN '2024-06-01' END AS terminated, CASE WHEN c_custkey % 3 <> 1 THEN c_custkey::VARCHAR END AS number, c_custkey % 2 = 0 AS public, c_nationkey FROM customer)"""
_DRAFTS = f"""WITH {_FULL}, dr AS (SELECT fd.*, CASE WHEN n_nationkey IS NOT NULL THEN n_name ELSE court_id END AS court, n_nationkey IS NOT NULL AS known, CASE WHEN n_nationkey % 2 = 0 THEN 'S' || n_nationkey END AS state, CASE WHEN k % 3 = 0 THEN titled ELSE name END AS caption FROM fd LEFT JOIN nation ON court_id = 'court' || n_nationkey AND n_nationkey < 20
), dd AS (SELECT *, array_to_string(string_split_regex(trim(regexp_replace(lower(caption), '[^a-z0-9]+', ' ', 'g')), ' +')[1:6], '-') || '-cl' || docket_id AS id,
    CASE WHEN platform = '' THEN 'platform,' ELSE '' END || 'contractType,gate,doctrinalQuestion,posture,statutes,summary' || CASE WHEN known THEN '' ELSE ',courtForum,forum,states' END || ',parties.role' AS needs FROM dr)"""
_PRESS = """pr0 AS (SELECT p_partkey AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM part
), pr1 AS (SELECT k, CASE k % 5 WHEN 0 THEN name || ' v. Kalshi Group insider case settled' WHEN 1 THEN 'Rule on event contract: proposed' WHEN 2 THEN 'CFTC fined ' || name || ' in prediction market fraud' WHEN 3 THEN 'Weather is fine today' ELSE 'complaint against ' || name || ': event contract' END AS title,
    CASE k % 3 WHEN 0 THEN 'https://x/docket/' || k || '/' WHEN 1 THEN 'release ' || (k % 9000 + 1000) || '-24' ELSE 'y' END AS link, strftime(DATE '2024-01-01' + CAST(k % 300 AS INTEGER), '%Y-%m-%d') AS d, name FROM pr0
), pr2 AS (SELECT *, CASE WHEN k % 5 = 1 THEN 'regulatory' ELSE 'enforcement' END AS section, CASE k % 5 WHEN 0 THEN 'Settled/penalty' WHEN 1 THEN 'Regulatory' ELSE 'Charged' END AS status, CASE k % 5 WHEN 0 THEN 'amber' WHEN 1 THEN 'emerald' ELSE 'red' END AS colour,
    CASE k % 5 WHEN 0 THEN name || ' v. Kalshi Group' WHEN 1 THEN 'Rule on event contract' WHEN 2 THEN 'CFTC' ELSE 'complaint against ' || name END AS actors FROM pr1 WHERE k % 5 <> 3
), pr3 AS (SELECT *, CASE k % 3 WHEN 0 THEN 'cl' || k WHEN 1 THEN 'pr' || (k % 9000 + 1000) || '-24' ELSE 'actor:' || lower(actors) END AS key FROM pr2)"""
_MORE = {
    "stream_watchlist": f"""WITH b AS (SELECT user_id AS market, count(*) AS trades, sum(value) AS usd, CAST(max(greatest(0, CASE WHEN {_P} >= 0.95 THEN least(15, {_WP}) ELSE {_WP} END)) AS INTEGER) AS score FROM events WHERE event_type <> 'signup' GROUP BY user_id
      ), r AS (SELECT DISTINCT user_id AS market FROM events WHERE event_type = 'signup' AND value > 100), m AS (SELECT coalesce(b.market, r.market) AS market, coalesce(trades, 0) AS trades, coalesce(usd, 0) AS usd, coalesce(score, 0) AS score, r.market IS NOT NULL AS resolved FROM b FULL JOIN r ON b.market = r.market)
      SELECT market, trades, round(usd + 1e-7, 3) AS usd, score, CASE WHEN resolved THEN CASE WHEN market % 2 = 0 AND score >= 65 THEN 'promoted' ELSE 'cleared' END WHEN score >= 25 THEN 'listed' ELSE 'open' END AS status FROM m""",
    "stream_sessions": """WITH o AS (SELECT user_id AS market, epoch_us(ts) AS t, value, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events
      ), s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o), g AS (SELECT market, k, min(t) AS start, max(t) + 21600000000 AS "end", count(*) AS n, round(sum(value) + 1e-7, 3) AS usd FROM s GROUP BY market, k)
      SELECT market, start, "end", n, usd FROM g WHERE "end" <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""",
    "stream_sliding": """WITH s AS (SELECT (CAST(floor(epoch(ts)) AS BIGINT) // 10800 - k) * 10800 AS start FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, count(*) AS n FROM s WHERE start + 21600 <= (SELECT max(epoch(ts)) FROM events) - 600 GROUP BY start""",
    "stream_once": "SELECT DISTINCT user_id AS market, event_type AS kind FROM events",
    "stream_catalog": f"{V} SELECT c.category, count(*) AS n, round(sum(value) + 1e-7, 3) AS usd FROM events JOIN catalog c ON user_id = cond GROUP BY c.category",
    "stream_positions": "SELECT user_id AS market, count(*) AS trades, round(sum(value) + 1e-7, 3) AS usd FROM events GROUP BY user_id",
    "stream_alerts": "SELECT user_id AS market, arg_min(event_id, (ts, event_id)) AS id, arg_min(value, (ts, event_id)) AS usd FROM events WHERE value >= 100 GROUP BY user_id",
    "stream_dockets": "SELECT DISTINCT o_custkey AS docket_id FROM orders",
    "sketch_error": "SELECT true AS near",
    "null_facts": f"{POSITIONS}, f AS (SELECT count(*) AS n, count(*) FILTER (WHERE won) AS observed, sum(entry) AS expected, sqrt(sum(entry * (1 - entry))) AS sd FROM positions) SELECT n, observed, {_r('expected', 'sd')}, round((f.observed - f.expected) / f.sd + 1e-7, 3) AS z FROM f",
    "corroborated_rings": f"{_RINGS} SELECT funder, members, edges, {_r('mean_link', 'best', digits=4)} FROM rings",
    "ring_edges": f"{_RINGS}, x AS (SELECT p.funder, a, b, link, members, row_number() OVER (PARTITION BY p.funder ORDER BY round(link, 9) DESC, a, b) AS r FROM pairs p JOIN rings g ON p.funder = g.funder) SELECT funder, a, b, {_r('link', digits=4)} FROM x WHERE r <= members",
    "flagged_rings": f"""{FUSED}, ti AS (SELECT wallet, CASE {_TIER} WHEN 'high' THEN 'elevated' WHEN 'notable' THEN 'watch' ELSE {_TIER} END AS tier FROM fused WHERE {_TIER} <> 'unflagged'
      ), w AS (SELECT 'w' || c_custkey AS wallet, CASE WHEN c_custkey % 20 = 0 THEN 'hub-' || c_nationkey ELSE c_nationkey || '-' || (c_custkey // 100) END AS funder FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))
      SELECT funder, count(*) AS size, count(tier) AS flagged, arg_min(tier, CASE tier WHEN 'extreme' THEN 0 WHEN 'elevated' THEN 1 WHEN 'watch' THEN 2 END) AS worst FROM w LEFT JOIN ti USING (wallet) GROUP BY funder HAVING count(tier) >= 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 30""",
    "ring_aggregate": f"""{POSITIONS}, f AS (SELECT o_custkey, min(CAST(epoch(o_orderdate) AS BIGINT)) AS first_seen_ts FROM orders GROUP BY 1), w AS (SELECT 'w' || c_custkey AS wallet, CASE WHEN c_custkey % 20 = 0 THEN 'hub-' || c_nationkey ELSE c_nationkey || '-' || (c_custkey // 100) END AS funder, first_seen_ts FROM customer JOIN f ON c_custkey = o_custkey
      ), m AS (SELECT funder, count(*) AS members, min(first_seen_ts) AS created_ts, bool_and(coalesce(prior_tx = 0, false)) AS untouched FROM w JOIN accounts USING (wallet) GROUP BY funder
      ), b AS (SELECT funder, count(*) AS bets, sum(stake) AS stake, sum(pnl) AS pnl, min(ts) AS first_ts FROM w JOIN positions USING (wallet) GROUP BY funder) SELECT funder, members, bets, {_r('stake', 'pnl', digits=2)}, first_ts, created_ts, untouched FROM m JOIN b USING (funder)""",
    "ring_split": f"{PAIRS}, x AS (SELECT funder AS component, event_group, count(DISTINCT wallet) AS n FROM w JOIN e USING (wallet) GROUP BY 1, 2) SELECT component, round(count(*) FILTER (WHERE n >= 2) / count(*) + 1e-7, 4) AS split_ratio FROM x GROUP BY component",
    "linked_clusters": f"""{PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, links AS (SELECT a, b FROM pairs WHERE link >= 0.6 UNION SELECT b, a FROM pairs WHERE link >= 0.6), reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
      ), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node), i AS (SELECT component, count(*) AS edges, avg(link) AS mean_link FROM pairs JOIN comp ON a = node GROUP BY component), z AS (SELECT component, count(*) AS members FROM comp GROUP BY component)
      SELECT component, members, edges, round(mean_link + 1e-7, 4) AS mean_link FROM i JOIN z USING (component) WHERE i.mean_link >= 0.62""",
    "first_funding": f"WITH {_TRANSFERS}, x AS (SELECT t AS wallet, arg_min(f, (ts, f)) AS funder, min(ts) AS funding_ts FROM t GROUP BY t) SELECT wallet, funder, funding_ts, n_name AS label FROM x LEFT JOIN nation ON funder = n_nationkey",
    "prior_transactions": f"WITH {_TRANSFERS} SELECT f AS wallet, count(*) FILTER (WHERE f % 5 = 0 OR ts < 900000000) AS prior_tx FROM t JOIN customer ON f = c_custkey GROUP BY f",
    "cash_out": f"WITH {_TRANSFERS} SELECT f AS wallet, round((min(ts) - 900000000) / 3600 + 1e-7, 4) AS hours FROM t JOIN customer ON f = c_custkey WHERE ts >= 900000000 GROUP BY f",
    "docket_drafts": f"""{_DRAFTS} SELECT id, caption, CASE WHEN platform = '' THEN 'Other' ELSE platform END AS platform, court, 'Federal court' AS forum, coalesce(state, '') AS states, filed AS filed_date, terminated AS decided_date,
      'New filing, found on 2024-07-01. Filed ' || CASE WHEN filed IS NOT NULL THEN filed || ' in ' ELSE 'in ' END || court || CASE WHEN number IS NOT NULL THEN ' (docket ' || number || ')' ELSE '' END || '. Merits and posture not yet reviewed.' AS summary, needs AS needs_review FROM dd""",
    "approved_drafts": f"{_DRAFTS} SELECT id, 'doctrinalQuestion,statutes,summary,parties.role' AS \"left\" FROM dd WHERE platform = 'Venue'",
    "matter_refresh": """WITH m AS (SELECT o_orderkey AS id, o_orderdate::DATE AS filed, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE WHEN o_orderkey % 2 = 0 THEN DATE '2030-01-01' END AS last, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE END AS decided, o_orderkey % 2 = 0 AS pending,
        o_orderdate::DATE + CAST(o_orderkey % 900 AS INTEGER) AS filing, CASE WHEN o_orderkey % 11 = 0 THEN DATE '2029-01-01' END AS modified, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE + 30 END AS ended FROM orders
      ), n AS (SELECT *, greatest(filed, least(filing, DATE '1999-06-30'), CASE WHEN modified IS NOT NULL THEN least(modified, DATE '1999-06-30') ELSE filed END) AS newest FROM m)
      SELECT id, strftime(CASE WHEN last IS NULL OR newest > last OR last > DATE '1999-06-30' THEN newest ELSE last END, '%Y-%m-%d') AS last_update, strftime(coalesce(decided, ended), '%Y-%m-%d') AS decided_date, coalesce(ended IS NOT NULL AND pending, false) AS flag_outcome FROM n""",
    "press_tracker": f"WITH {_PRESS}, old AS (SELECT DISTINCT key FROM pr3 WHERE d < '2024-02-01'), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d DESC, section DESC, actors DESC, title DESC, link DESC, status DESC) AS r FROM pr3 ANTI JOIN old USING (key)) SELECT key, d, section, actors, status, colour FROM r WHERE r = 1",
    "court_tracker": f"""WITH {_FULL} SELECT filed AS d, CASE WHEN k % 3 = 0 THEN upper(name) ELSE name END AS actors, 'Event-contract enforcement docket (' || coalesce(number, 'verify') || '); details pending review.' AS sum, '/docket/' || docket_id || '/' AS src, 'Charged' AS status FROM fd WHERE c_nationkey % 3 = 1 OR (public AND c_nationkey % 3 = 2)""",
    "matter_search": f"{MATTERS} SELECT id, caption, outcome, filed_date FROM matters WHERE contains(lower(caption || ' ' || platform), 'urgent') AND outcome IN ('Permitted', 'Settled') AND list_has_any(states, ['S1', 'S2', 'S3', 'S4']) AND filed_date[1:4]::INT BETWEEN 1993 AND 1997",
    "forum_tilt": f"{MATTERS}, c AS (SELECT contract, forum, count(*) AS n, count(*) FILTER (WHERE outcome = 'Permitted') AS permitted, count(*) FILTER (WHERE outcome = 'Enjoined') AS enjoined FROM matters GROUP BY contract, forum) SELECT *, CASE WHEN permitted > enjoined THEN 'permitted' WHEN permitted < enjoined THEN 'enjoined' ELSE 'even' END AS tilt FROM c",
    "entity_edges": f"{MATTERS} SELECT platform, forum, outcome, count(*) AS n FROM matters GROUP BY ALL",
    "doctrine_flow": f"""{MATTERS}, x AS (SELECT CASE WHEN gate IN ('g0', 'g1', 'g2', 'g3') THEN gate ELSE 'special' END AS gate, id || '-' || platform || '-' || posture || '-' || array_to_string(states, '') AS id, caption, outcome, filed_date FROM matters
      ), r AS (SELECT gate, id, outcome, CAST(row_number() OVER (PARTITION BY gate ORDER BY list_position(['Permitted', 'Enjoined', 'Settled', 'Dismissed', 'Pending'], outcome), caption, id, filed_date NULLS FIRST) AS INTEGER) AS place FROM x) SELECT gate, place, id, outcome FROM r WHERE place <= 20""",
    "lookup_merge": f"""{POSITIONS}, p AS (SELECT wallet || '-' || cond AS cond, outcome, stake, pnl, tx, cond AS n FROM positions), f AS (SELECT cond, outcome, CASE WHEN n % 3 = 1 THEN stake + 1 END AS stake, pnl FROM p WHERE n % 3 <> 0), t AS (SELECT * FROM p WHERE n % 4 <> 0
      ), j AS (SELECT coalesce(f.cond, t.cond) AS cond, coalesce(f.outcome, t.outcome) AS outcome, coalesce(f.stake, t.stake) AS stake, coalesce(f.pnl, t.pnl) AS pnl, t.tx FROM f FULL JOIN t ON f.cond = t.cond AND f.outcome = t.outcome) SELECT cond, outcome, {_r('stake', 'pnl')}, tx FROM j""",
    "tx_backfill": f"""{POSITIONS}, b AS (SELECT * FROM trades WHERE side = 'BUY' AND (cond % 2 = 0 OR outcome = 'YES')), e AS (SELECT wallet, cond, outcome, arg_min(tx, (ts, tx)) AS tx FROM b GROUP BY ALL), n AS (SELECT wallet, cond, arg_min(tx, (ts, tx)) AS tx FROM b GROUP BY ALL)
      SELECT p.wallet, p.cond, p.outcome, coalesce(CASE WHEN p.tx % 2 = 0 THEN p.tx END, e.tx, n.tx) AS tx FROM positions p LEFT JOIN e ON p.wallet = e.wallet AND p.cond = e.cond AND p.outcome = e.outcome LEFT JOIN n ON p.wallet = n.wallet AND p.cond = n.cond""",
    "accumulated_bets": f"""{POSITIONS}, p AS (SELECT wallet, cond, outcome, stake, CASE WHEN tx % 2 = 0 THEN entry END AS z, pnl, ts FROM positions), q AS (SELECT wallet, cond, outcome, stake * CASE WHEN ts % 7 < 3 THEN 2 ELSE 0.5 END AS stake, pnl + 1 AS pnl, cond % 4 = 0 AS feed, ts + 5 AS ts FROM p WHERE cond % 2 = 0
      ), j AS (SELECT p.wallet, p.cond, p.outcome, greatest(p.stake, coalesce(q.stake, p.stake)) AS stake, CASE WHEN q.stake IS NULL THEN p.z WHEN p.z IS NULL OR q.stake >= p.stake THEN 9.0 ELSE p.z END AS z, CASE WHEN q.stake IS NULL THEN p.pnl WHEN feed OR q.stake >= p.stake THEN q.pnl ELSE p.pnl END AS pnl, coalesce(feed, false) AS from_feed, p.ts
      FROM p LEFT JOIN q USING (wallet, cond, outcome)) SELECT wallet, cond, outcome, {_r('stake', 'z', 'pnl')}, from_feed, ts FROM j""",
    "capped_queue": f"{QUEUE} SELECT * FROM queue ORDER BY (status = 'retired')::INT, last_scanned DESC, engine, market LIMIT 10",
    "first_flagged": """WITH h AS (SELECT 'w' || c_custkey AS wallet, 1700000000 - c_custkey * 500 AS f, c_nationkey FROM customer), x AS (SELECT wallet, CASE WHEN c_nationkey % 3 <> 0 THEN f ELSE 1700000000 END AS first_flagged, c_nationkey % 2 = 0 AS seen FROM h WHERE c_nationkey % 3 <> 0 OR c_nationkey % 2 = 0)
      SELECT wallet, first_flagged, 1700000000 - first_flagged <= 86400 AS newly, NOT seen AS archived FROM x""",
    "hydrated_bets": f"{POSITIONS} SELECT wallet, cond, CASE WHEN cond % 3 = 1 THEN 'own' WHEN cond % 5 <> 0 THEN question ELSE '(market)' END AS question FROM positions",
    "lean_bets": f"{POSITIONS} SELECT wallet, cond, outcome, {_r('entry', 'stake', 'pnl')}, won, held, ts, tx FROM positions",
    "holder_balances": "SELECT l_partkey % 200 AS market, l_suppkey AS wallet, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) + 1e-7, 2) AS balance FROM lineitem GROUP BY 1, 2 HAVING sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) > 0",
    "attribution": "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'proxy' WHEN 1 THEN 'maker' WHEN 2 THEN 'taker' ELSE 'other' END AS role, count(*) AS n, round(sum(o_totalprice) + 1e-7, 2) AS notional FROM orders GROUP BY 1",
    "tracker_orders": f"""{MATTERS}, x AS (SELECT id, max(filed_date) AS filed_date, min(caption) AS caption FROM matters WHERE filed_date IS NOT NULL GROUP BY id), y AS (SELECT *, strftime(CAST(filed_date AS DATE) + CAST(length(id) * 3 AS INTEGER), '%Y-%m-%d') AS last_update FROM x)
      (SELECT 'newest' AS by, id, filed_date, last_update, caption FROM y ORDER BY filed_date DESC, id LIMIT 30) UNION ALL (SELECT 'oldest', id, filed_date, last_update, caption FROM y ORDER BY filed_date, id LIMIT 30)
      UNION ALL (SELECT 'updated', id, filed_date, last_update, caption FROM y ORDER BY last_update DESC, id LIMIT 30) UNION ALL (SELECT 'name', id, filed_date, last_update, caption FROM y ORDER BY caption, id LIMIT 30)""",
    "tracker_newest": f"{MATTERS}, x AS (SELECT id, max(filed_date) AS filed_date FROM matters WHERE filed_date IS NOT NULL GROUP BY id) SELECT id, filed_date FROM x ORDER BY filed_date DESC, id LIMIT 50",
}


ORACLES: dict[str, str] = {
    "net_positions": f"{POSITIONS} SELECT cond, wallet, outcome, won, held, ts, {_r('entry', 'gross', 'stake', 'pnl', 'late', 'directional')} FROM positions",
    "market_cross_section": f"{BETS} SELECT cond, wallet, buyers, {_r('z_bet', 'z_profit')} FROM crossed WHERE z_profit IS NOT NULL",
    "price_shock": f"{BETS} SELECT cond, shock_ts, {_r('move', digits=4)} FROM shock",
    "surprise_markets": f"""{POSITIONS}, won AS (
      SELECT cond, sum(stake * entry) / sum(stake) AS implied, sum(stake) AS total_stake, max(stake) AS top_stake, count(*) AS winners FROM positions WHERE won AND stake > 0 GROUP BY cond
    ), s AS (SELECT *, 1 - implied AS surprise FROM won) SELECT cond, winners, {_r('implied', 'surprise', 'total_stake', 'top_stake')} FROM s WHERE surprise >= 0.30 AND total_stake >= 1000
      ORDER BY s.surprise * log10(greatest(10.0, s.top_stake)) DESC, cond LIMIT 400""",
    **{name: _named(key) for name, key in NAMES.items()},
    "fuse_tier": f"{FUSED} SELECT wallet, {_TIER} AS tier, CAST(agreeing AS INTEGER) AS agreeing, CAST(n_fired AS INTEGER) AS n_fired, fired FROM fused",
    **_PUBLISHED,
    **_SURVEILLANCE,
    "news_blackout": """WITH e AS (SELECT user_id % 20 AS entity, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, event_type, value FROM events
      ), n AS (SELECT b.event_id, count(x.ts) AS n, any_value(b.value) AS stake FROM e b LEFT JOIN e x ON x.event_type = 'error' AND x.entity = b.entity AND x.ts BETWEEN b.ts - 21600 AND b.ts WHERE b.event_type = 'purchase' GROUP BY b.event_id)
      SELECT event_id AS bet_id, n, n = 0 AS blackout, CAST(round(CASE WHEN n = 0 AND stake >= 20 THEN 0.6 WHEN n = 0 THEN 0.3 ELSE greatest(0.0, least(0.25, 0.2 - 0.02 * n)) END, 4) AS DOUBLE) AS score FROM n""",
    "regulatory_matches": """WITH e AS (SELECT user_id % 20 AS entity, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, event_type FROM events
      ), p AS (SELECT b.event_id AS bet_id, b.ts, x.ts AS found, row_number() OVER (PARTITION BY b.event_id ORDER BY x.ts DESC, x.event_id DESC) AS r FROM e b JOIN e x ON x.event_type = 'signup' AND x.entity = b.entity AND x.ts BETWEEN b.ts - 86400 AND b.ts + 259200 WHERE b.event_type = 'purchase')
      SELECT bet_id, CAST(count(*) FILTER (WHERE found >= ts) AS INTEGER) AS ahead, CAST(count(*) AS INTEGER) AS docs FROM p WHERE r <= 5 GROUP BY bet_id""",
    "funding_network": """WITH t AS (SELECT o_orderkey % 40 AS f, 1000 + o_custkey AS t, sum(o_totalprice) AS value, min(CAST(epoch(o_orderdate) AS BIGINT)) AS first_ts FROM orders GROUP BY 1, 2
      ), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value DESC, f) AS r FROM t WHERE t IN (SELECT 1000 + c_custkey FROM customer WHERE c_acctbal < 0)
      ), g AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY value DESC, t) AS r FROM t WHERE f IN (SELECT f FROM o WHERE r <= 3))
      SELECT o.t AS subject, o.f AS funder, g.t AS recipient, round(g.value + 1e-7, 2) AS value, g.first_ts FROM o JOIN g ON o.f = g.f AND g.r <= 30 WHERE o.r <= 3 AND o.t <> g.t""",
    "episode_score": f"""{BETS}, s0 AS (SELECT wallet, avg(stake) AS m, stddev_samp(stake) AS sd FROM bets WHERE stake > 0 GROUP BY wallet
    ), e0 AS (SELECT b.*, CASE WHEN sd > 0 THEN (stake - m) / sd ELSE 0 END AS zw FROM bets b LEFT JOIN s0 USING (wallet) WHERE z_bet IS NOT NULL AND pnl >= 250 AND entry <= 0.9
    ), e1 AS (SELECT *, 30 * z_profit + 25 * z_bet + 20 * zw + 15 * late + 10 * directional AS s FROM e0 WHERE (z_bet > 2 OR zw > 2) AND won AND z_profit > 0
    ), e2 AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY s DESC, cond) AS r, count(*) OVER (PARTITION BY wallet) AS retained FROM e1)
    SELECT wallet, cond, {_r('s', digits=2)}, retained, CASE WHEN e2.s >= 1110 THEN 'extreme' WHEN e2.s >= 810 THEN 'high' WHEN e2.s >= 530 THEN 'notable' END AS tier FROM e2 WHERE r = 1""",
    "bh_cutoff": f"""{RECORDS}, pv AS (SELECT {_TAIL} AS p FROM records WHERE ls_groups >= 5), rk AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM pv)
      SELECT max(m) AS m, CASE WHEN max(m) < 50 THEN 1.0 ELSE round(least(1.0::DOUBLE, coalesce(max(CASE WHEN p <= r / m * 0.25 AND p <= 0.25 THEN p END), 0.0)), 5) END AS cut FROM rk""",
    "percentile": f"{RECORDS}, x AS (SELECT wallet, round(pnl, 2) AS pnl FROM records) SELECT wallet, round(pnl, 3) + 0.0::DOUBLE AS pnl, round(least(99.999::DOUBLE, 100 * (rank() OVER (ORDER BY x.pnl) - 1) / count(*) OVER ()), 3) AS percentile FROM x",
    "record_profile": f"{RECORDS} SELECT wallet, bets, wins, {_r('pnl', 'mean_odds', 'median_stake', 'max_event')} FROM records",
    "run_up": f"{RUN_UP} SELECT market, n, {_r('car', 'car_star', 'score', 'pre_move', digits=4)} FROM run_up",
    "vpin": f"{V}{VPIN} SELECT market, trades, buckets, {_r('vpin', digits=4)} FROM vpin",
    "price_impact": f"{V}{IMPACT} SELECT market, bars, {_r('slope', 'ratio', digits=4)}, round({_ISCORE}, 4) AS score FROM impact",
    "hhi": f"""{VOLUMES}, t AS (SELECT cond, sum(buy_usd) AS total, sum(buy_usd * buy_usd) AS sq, max(buy_usd) AS top, count(*) FILTER (WHERE buy_usd > 0) AS wallets FROM volumes GROUP BY cond)
      SELECT cond, wallets, round(1e-7 + sq / (total * total), 6) AS hhi, round(1e-7 + top / total, 6) AS top, round(1e-7 + {_clip('0.55 * sq / (total * total) + 0.45 * top / total')}, 6) AS score FROM t WHERE total > 0""",
    "wash": f"{VOLUMES}, t AS (SELECT cond, 2 * sum(least(buy_usd, sell_usd)) / sum(buy_usd + sell_usd) AS s FROM volumes GROUP BY cond) SELECT cond, round(1e-7 + s, 6) AS self_share, round(1e-7 + {_clip('0.7 * s')}, 6) AS score FROM t",
    "ramp": f"{V}{RAMP} SELECT market, {_r('close_share', 'move', 'times', 'score', digits=4)} FROM ramp",
    "sync_entry": f"""{VOLUMES}, t AS (SELECT cond, sum(buy_usd) AS total FROM volumes GROUP BY cond), s AS (SELECT v.cond, first_ts, buy_usd / total AS part FROM volumes v JOIN t USING (cond) WHERE first_ts IS NOT NULL
      ), g AS (SELECT cond, first_ts, count(*) OVER w AS size, round(sum(part) OVER w, 9) AS share FROM s WINDOW w AS (PARTITION BY cond ORDER BY first_ts RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING)
      ), b AS (SELECT *, row_number() OVER (PARTITION BY cond ORDER BY share DESC, first_ts, size DESC) AS r FROM g WHERE size >= 3)
      SELECT cond, size, round(1e-7 + share, 6) AS share, first_ts AS anchor FROM b WHERE r = 1""",
    "bars_daily": f"{V} SELECT cond, (ts // 86400) * 86400 AS start, round(arg_max(price, ts * 1000000000 + tx), 3) AS p, round(sum(size * price), 3) AS volume, count(*) AS n FROM trades GROUP BY 1, 2",
    "market_fuse": f"""{V}{RAMP}{IMPACT}{VPIN}, l AS (SELECT market, 0.25::DOUBLE AS w, score AS sub FROM ramp UNION ALL SELECT market, 0.25::DOUBLE, {_ISCORE} FROM impact UNION ALL SELECT market, 0.20::DOUBLE, vpin FROM vpin
      ), f AS (SELECT market, sum(w * sub) / sum(w) AS raw, count(*) AS ran, count(*) FILTER (WHERE sub >= 0.45) AS agreeing FROM l GROUP BY market
      ), g AS (SELECT *, floor(100 * {_clip('raw')} * ran / 4 + 0.5) AS score FROM f)
      SELECT market, {_r('raw')}, ran, agreeing, CASE WHEN score >= 50 AND agreeing >= 1 THEN 'Elevated' WHEN score >= 30 THEN 'Watch' ELSE 'Clear' END AS tier FROM g""",
    "price_as_of_noon": f"""{V}, q AS (SELECT DISTINCT market, (t // 86400000000) * 86400000000 + 43200000000 AS at FROM series)
      SELECT q.market, q.at, round(1e-7 + coalesce(arg_max(s.p, s.t) FILTER (WHERE s.t <= q.at), arg_min(s.p, s.t)), 6) AS price_at FROM q JOIN series s USING (market) GROUP BY q.market, q.at""",
    "funder_pairs": f"{PAIRS} SELECT a, b, funder, shared, {_r('co_spend', 'sync', 'near', 'link', digits=4)}, type FROM pairs",
    "wallet_components": f"""{PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, links AS (SELECT a, b FROM pairs WHERE link >= 0.6 UNION SELECT b, a FROM pairs WHERE link >= 0.6
      ), reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a) SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "address_sets": """WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 2 THEN ['0xa' || o_custkey] ELSE list_sort(['0xa' || o_custkey, '0xb' || (o_custkey % 97)]) END AS members, o_totalprice AS profit, o_orderkey AS run, o_orderkey % 10 = 0 AS rejected FROM orders
      ), last AS (SELECT members, arg_max(profit, run) AS profit, arg_max(rejected, run) AS rejected FROM s GROUP BY members), m AS (SELECT unnest(members) AS address, profit / len(members) AS profit FROM last WHERE NOT rejected) SELECT address, round(sum(profit) + 1e-7, 2) AS profit FROM m GROUP BY address""",
    "state_rollup": f"{MATTERS}, x AS (SELECT unnest(states) AS state, posture, rank FROM matters) SELECT state, count(*) AS n, arg_min(posture, rank) AS posture FROM x GROUP BY state",
    "validation_problems": f"""{MATTERS} SELECT id, 'missing filed_date' AS problem FROM matters WHERE filed_date IS NULL
      UNION ALL SELECT id, 'decided_date is no date' FROM matters WHERE decided_date = '2020-13-01' UNION ALL SELECT id, 'decided before filed' FROM matters WHERE decided_date = '1990-01-01' AND filed_date > '1990-01-01'
      UNION ALL SELECT id, 'duplicate id' FROM matters GROUP BY id HAVING count(*) > 1""",
    "matter_validation": f"""{MATTERS}, m AS (SELECT *, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS n FROM matters), x AS (SELECT 'missing filed_date' AS problem FROM m WHERE filed_date IS NULL UNION ALL SELECT 'missing parties' FROM m WHERE n % 19 = 0 UNION ALL SELECT 'missing statutes' FROM m WHERE n % 23 = 0
      UNION ALL SELECT 'missing summary' FROM m WHERE n % 29 = 0 UNION ALL SELECT 'statutes must be a list' FROM m WHERE n % 23 = 0 UNION ALL SELECT 'platform: ' || platform FROM m WHERE platform = 'p3' UNION ALL SELECT 'contract: ' || contract FROM m WHERE contract = 'c2' UNION ALL SELECT 'forum: ' || forum FROM m WHERE forum = 'P'
      UNION ALL SELECT 'outcome: ' || outcome FROM m WHERE outcome = 'Pending' UNION ALL SELECT 'posture: ' || posture FROM m WHERE posture = 'Dismissed' UNION ALL SELECT 'gate: ' || gate FROM m WHERE gate = 'g6' UNION ALL SELECT 'decided_date is no date' FROM m WHERE decided_date = '2020-13-01'
      UNION ALL SELECT 'decided before filed' FROM m WHERE decided_date = '1990-01-01' AND filed_date > '1990-01-01' UNION ALL SELECT 'parties[1] needs name and role' FROM m WHERE n % 19 <> 0 AND (n % 5 = 0 OR n % 7 = 0)
      UNION ALL SELECT 'state ' || s || ' is not on the map' FROM (SELECT unnest(states) AS s FROM m) WHERE CAST(s[2:] AS INTEGER) >= 45 UNION ALL SELECT 'duplicate id' FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1)) SELECT problem, count(*) AS n FROM x GROUP BY problem""",
    "crosstab": f"{MATTERS} SELECT contract, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("Permitted", "Enjoined", "Settled", "Dismissed", "Pending")) + " FROM matters GROUP BY contract",
    "entity_degree": f"{MATTERS} SELECT 'platform' AS kind, platform AS name, count(*) AS degree FROM matters GROUP BY platform UNION ALL SELECT 'forum', forum, count(*) FROM matters GROUP BY forum",
    "analog_vote": f"""{MATTERS}, sc AS (SELECT n_nationkey AS scenario, 'c' || (n_nationkey % 3) AS contract, CASE WHEN n_nationkey % 2 = 0 THEN 'O' ELSE 'F' END AS forum, 'S' || n_nationkey AS state, 'g' || (n_nationkey % 7) AS gate FROM nation
      ), x AS (SELECT scenario, outcome, 3 * (m.contract = sc.contract)::INT + 3 * (m.forum = sc.forum)::INT + 2 * list_contains(states, state)::INT + 2 * (m.gate = sc.gate)::INT AS score, 2 * list_contains(states, state)::INT AS bonus FROM matters m, sc
      ), y AS (SELECT scenario, outcome, count(*) AS n, sum(score + bonus) AS votes FROM x WHERE score > 0 GROUP BY 1, 2
      ), z AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY (outcome = 'Pending')::INT, votes DESC, outcome) AS r FROM y)
      SELECT scenario, CAST(sum(n) AS BIGINT) AS matches, coalesce(max(CASE WHEN r = 1 AND outcome <> 'Pending' THEN outcome END), 'Unsettled') AS predicted FROM z GROUP BY scenario""",
    "docket_relevance": f"{DOCKETS} SELECT case_name, docket_id, accept, platform, reason FROM dockets",
    "docket_diff": f"""{DOCKETS}, m AS (SELECT o_orderkey * 7 AS docket_id, 'matter-cl' || (o_orderkey * 7) AS known, CASE WHEN o_orderkey % 3 = 0 THEN '2020-01-01' END AS decided FROM orders WHERE o_orderstatus = 'F'
      ), l AS (SELECT DISTINCT s_suppkey * 7 AS docket_id, true AS seen FROM supplier
      ), a AS (SELECT docket_id, case_name, terminated FROM dockets WHERE accept AND docket_id IS NOT NULL)
      SELECT docket_id, coalesce(known, array_to_string(string_split_regex(trim(regexp_replace(lower(case_name), '[^a-z0-9]+', ' ', 'g')), ' +')[1:6], '-') || '-cl' || docket_id) AS id,
        CASE WHEN known IS NOT NULL THEN CASE WHEN terminated IS NOT NULL AND decided IS NULL THEN 'UPSERT' ELSE 'SKIP' END WHEN seen THEN 'SKIP' ELSE 'INSERT' END AS action
      FROM a LEFT JOIN m USING (docket_id) LEFT JOIN l USING (docket_id)
      UNION ALL SELECT docket_id, NULL, 'HELD' FROM dockets WHERE NOT accept OR docket_id IS NULL""",
    "queue_upsert": f"{QUEUE} SELECT * FROM queue",
    "queue_audit": f"{QUEUE} SELECT last_scanned AS ts, engine, market, change AS type, tier FROM queue WHERE change <> 'same'",
    "cumulative_ledger": """WITH s AS (SELECT o_custkey % 500 AS key, o_totalprice AS profit, o_orderkey % 10 = 0 AS rejected, row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey DESC, o_totalprice DESC) AS r FROM orders
      ), x AS (SELECT unnest(['a' || key, 'a' || (key * 2)]) AS address, profit / 2 AS profit FROM s WHERE r = 1 AND NOT rejected) SELECT address, round(1e-7 + sum(profit), 2) AS profit FROM x GROUP BY address""",
    "pool_retention": f"""{RECORDS}, q AS (SELECT wallet, wins >= 12 AS protected, greatest(round(coalesce(median_stake, 0), 2), round(max_event, 2)) + 750 * wins + 50 * bets AS signal FROM records
      ), k AS (SELECT * FROM q WHERE NOT protected ORDER BY signal DESC, wallet LIMIT 300) SELECT wallet, protected, round(signal, 2) AS signal FROM k UNION ALL SELECT wallet, protected, round(signal, 2) FROM q WHERE protected""",
    "reconcile_bets": f"""{POSITIONS}, t AS (SELECT wallet, cond, stake, pnl, won, tx FROM positions
      ), g AS (SELECT wallet, cond, stake, pnl + 1 AS pnl, CASE WHEN cond % 4 = 0 THEN won END AS won FROM t WHERE cond % 4 IN (0, 3)), t2 AS (SELECT * FROM t WHERE cond % 4 <> 3
      ), j AS (SELECT coalesce(t2.wallet, g.wallet) AS wallet, coalesce(t2.cond, g.cond) AS cond, coalesce(t2.stake, g.stake) AS stake, coalesce(g.pnl, t2.pnl) AS pnl, coalesce(g.won, t2.won) AS won, t2.tx,
        CASE WHEN g.wallet IS NULL THEN 'trades' WHEN t2.wallet IS NULL THEN 'feed' ELSE 'both' END AS source FROM t2 FULL JOIN g ON t2.wallet = g.wallet AND t2.cond = g.cond)
      SELECT wallet, cond, won, tx, source, {_r('stake', 'pnl')} FROM j""",
    "watch_score": f"{WATCH} SELECT cond, wallet, tx, outsized, conviction, repeat, fresh, score, score >= 25 AS listed, {_r('vol_share', 'whale_x', digits=4)} FROM watch",
    "detector_lift": f"""{FUSED}, rates AS (SELECT wallet, wins / bets AS rate FROM records), e AS (SELECT count(*) AS n, sum(rate) AS total FROM rates
      ), o AS (SELECT detector, count(*) AS n_fired, sum(rate) AS sf FROM long JOIN rates USING (wallet) WHERE fires GROUP BY detector)
      SELECT detector, n_fired, n - n_fired AS n_other, round(1e-7 + sf / n_fired, 6) AS rate_fired, round(1e-7 + (total - sf) / nullif(n - n_fired, 0), 6) AS rate_other, n_fired >= 8 AND n - n_fired >= 8 AS reliable FROM o, e""",
    "shadow_distribution": f"""{BETS}, s AS (SELECT round(z_profit * 30 + z_bet * 25, 2) AS s FROM bets WHERE z_profit IS NOT NULL AND z_bet IS NOT NULL), l AS (SELECT list_sort(list(s)) AS v, count(*) AS n, count(*) FILTER (WHERE s > 500) AS over_500 FROM s)
      SELECT n, """ + ", ".join(f"round(v[CAST(floor(n * {q}::DOUBLE) AS BIGINT) + 1], 2) AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + ", over_500 FROM l",
    "feed_profile": "WITH f AS (SELECT count(*) AS n, " + ", ".join(f"count({c}) AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")) + " FROM events) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS present, n - {c} AS missing FROM f" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")),
    "stream_bars": f"""{V}, b AS (SELECT user_id AS market, date_trunc('day', ts) AS start, round(arg_max(0.05::DOUBLE + 0.9::DOUBLE * value / (value + 20), (epoch_us(ts), event_id)), 3) AS p, round(sum(value), 3) AS volume, count(*) AS n FROM events GROUP BY 1, 2)
      SELECT market, CAST(epoch(start) AS BIGINT) AS start, p, volume, n FROM b WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    **_MORE,
}
