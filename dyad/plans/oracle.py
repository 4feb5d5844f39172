"""Single-node SQL statements of the catalogue's queries, for comparison of results."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
SQL: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _needed(text: str) -> list[str]:
    """Names of the shared tables a statement refers to, dependencies first."""
    found: list[str] = []

    def visit(t: str) -> None:
        for name in CTES:
            if name not in found and re.search(rf"(?:FROM|JOIN)\s+{name}\b", t):
                visit(CTES[name])
                if name not in found:
                    found.append(name)
    visit(text)
    return [n for n in CTES if n in found]


def oracle(name: str, columns: str, body: str) -> None:
    """`columns`: plain names are bigint, ~name a rounded double, $name text."""
    out = []
    for c in columns.split():
        if c[0] == "~":
            out.append(f"ROUND(ROUND(CAST({c[1:]} AS DOUBLE) * 1e6, 3)) / 1e6 + 0.0 AS {c[1:]}")
        elif c[0] == "$":
            out.append(f"CAST({c[1:]} AS VARCHAR) AS {c[1:]}")
        else:
            out.append(f"CAST({c} AS BIGINT) AS {c}")
    withs = ",\n".join(f"{n} AS ({CTES[n]})" for n in _needed(body))
    head = f"WITH {withs}\n" if withs else ""
    SQL[name] = f"{head}SELECT {', '.join(out)} FROM ({body.strip()}) AS answer"


def pct(x: str, part: str) -> str:
    """Average-rank percentile of x inside a partition."""
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST) "
            f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}) END")


def topk(x: str, k: int) -> str:
    return f"list_avg(list_slice(list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL), 'DESC'), 1, {k}))"


def nearest(x: str, q: float) -> str:
    return f"list_sort(list({x}))[1 + CAST(floor({q} * (count({x}) - 1) + 0.5) AS BIGINT)]"


PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
KINDS = ["fold", "check", "call", "bet", "raise"]

cte("log", """
SELECT user_id // 15 AS table_id, CAST(user_id // 15 AS VARCHAR) || '-' || CAST(es // 21600 AS VARCHAR) AS hand_id,
       (es // 21600) * 21600 AS started_at,
       CASE WHEN day(ts) <= 18 THEN 'development' ELSE 'evaluation' END AS phase,
       CAST((es % 21600) // 5400 AS INTEGER) AS street,
       row_number() OVER (PARTITION BY user_id // 15, es // 21600 ORDER BY ts, event_id) - 1 AS action_no,
       user_id AS player_id,
       CASE event_type WHEN 'error' THEN 'fold' WHEN 'view' THEN 'check' WHEN 'click' THEN 'call'
            WHEN 'signup' THEN 'bet' ELSE 'raise' END AS action,
       CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS y,
       CAST(round(value * 100) AS BIGINT) AS amount,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS strength
FROM (SELECT *, epoch_us(ts) // 1000000 AS es FROM events) AS e""")

cte("act0", f"""
SELECT l.*, count(*) OVER own AS own_act_before, coalesce(sum((y >= 3)::INT) OVER own, 0) AS own_agg_before,
       coalesce(sum((y = 0)::INT) OVER own, 0) AS own_folds_before,
       coalesce(sum(amount) OVER own, 0) AS invested_before,
       coalesce(sum((y >= 3)::INT) OVER st, 0) AS n_agg_st, count(*) OVER st AS n_act_st,
       coalesce(sum((y >= 3)::INT) OVER h, 0) AS n_agg_hand, coalesce(sum(amount) OVER h, 0) AS pot_before,
       last_value(CASE WHEN y >= 3 THEN player_id END IGNORE NULLS) OVER h AS last_agg,
       last_value(CASE WHEN y >= 3 THEN amount END IGNORE NULLS) OVER h AS last_agg_amount,
       last_value(CASE WHEN y >= 3 THEN street END IGNORE NULLS) OVER h AS last_agg_street,
       count(*) OVER (PARTITION BY hand_id) AS hand_actions
FROM log AS l
WINDOW own AS (PARTITION BY hand_id, player_id ORDER BY action_no {PREV}),
       st AS (PARTITION BY hand_id, street ORDER BY action_no {PREV}),
       h AS (PARTITION BY hand_id ORDER BY action_no {PREV})""")

cte("act1", f"""
SELECT a.*, y = 0 AND own_folds_before = 0 AS is_exit,
       sum((own_act_before = 0)::INT) OVER (PARTITION BY hand_id) AS players_dealt,
       coalesce(sum((y = 0 AND own_folds_before = 0)::INT)
                OVER (PARTITION BY hand_id ORDER BY action_no {PREV}), 0) AS exits_before
FROM act0 AS a""")

cte("act", """
SELECT *, coalesce(last_agg = player_id, false)::INT AS self_last_agg,
       CASE WHEN last_agg IS NOT NULL AND last_agg <> player_id THEN last_agg_amount ELSE 0 END AS to_call,
       players_dealt - exits_before AS players_active,
       players_dealt - 1 - exits_before + (own_folds_before > 0)::INT AS live_opponents,
       1000000 - invested_before AS stack_before
FROM act1""")

oracle("running_context", "$hand_id action_no n_agg_hand n_agg_st own_agg_before n_act_st own_act_before last_agg "
       "self_last_agg invested_before pot_before to_call players_active live_opponents", "SELECT * FROM act")

cte("hand", """SELECT hand_id, table_id, started_at, phase, count(*) AS hand_actions,
       count(DISTINCT player_id) AS players_dealt, sum(amount) AS final_pot
FROM log GROUP BY ALL""")

cte("hand_order", """SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY started_at, hand_id) AS t_order,
       count(*) OVER (PARTITION BY table_id) AS table_hands FROM hand""")

oracle("table_order", "$hand_id table_id t_order $split_phase block", """
SELECT *, CASE WHEN t_order <= floor(table_hands * 0.6) THEN 'development' ELSE 'evaluation' END AS split_phase,
       (t_order - 1) * 4 // table_hands AS block FROM hand_order""")

oracle("group_folds", "table_id plain_fold shuffled_fold folds_seen", """
SELECT DISTINCT table_id, table_id % 5 AS plain_fold,
       CAST('0x' || substr(md5(CAST(table_id AS VARCHAR) || '|folds'), 1, 8) AS BIGINT) % 5 AS shuffled_fold,
       1 AS folds_seen FROM log""")

oracle("economics", "$hand_id action_no ~to_call_bb ~pot_bb ~stack_bb ~amount_bb ~pot_odds ~call_stack ~stack_to_pot "
       "~bet_ratio", """
SELECT hand_id, action_no, to_call / 10000.0 AS to_call_bb, pot_before / 10000.0 AS pot_bb,
       stack_before / 10000.0 AS stack_bb, amount / 10000.0 AS amount_bb,
       to_call::DOUBLE / greatest(pot_before + to_call, 1) AS pot_odds,
       to_call::DOUBLE / greatest(stack_before, 1) AS call_stack,
       stack_before::DOUBLE / greatest(pot_before, 1) AS stack_to_pot,
       to_call::DOUBLE / greatest(pot_before, 1) AS bet_ratio FROM act""")

cte("attribution", """
SELECT coalesce(w.hand_id, i.hand_id) AS hand_id, coalesce(w.player_id, i.player_id) AS player_id, folded_to,
       coalesce(folds_induced, 0) AS folds_induced
FROM (SELECT hand_id, player_id, last_agg AS folded_to FROM act WHERE is_exit AND last_agg IS NOT NULL) AS w
FULL JOIN (SELECT hand_id, last_agg AS player_id, count(*) AS folds_induced FROM act
           WHERE is_exit AND last_agg IS NOT NULL GROUP BY 1, 2) AS i
  ON w.hand_id = i.hand_id AND w.player_id = i.player_id""")

oracle("fold_attribution", "$hand_id player_id folded_to folds_induced", "SELECT * FROM attribution")

cte("seat0", """
SELECT table_id, phase, started_at, hand_id, player_id, count(*) AS n_actions,
       count(*) FILTER (action = 'raise') AS raises, count(*) FILTER (action = 'bet') AS bets,
       count(*) FILTER (action = 'call') AS calls, count(*) FILTER (action = 'check') AS checks,
       count(*) FILTER (action = 'fold') AS folds, count(*) FILTER (y IN (3, 4)) AS aggressive_actions,
       count(*) FILTER (y IN (3, 4) AND street > 0) AS postflop_aggressive,
       count(*) FILTER (y = 1 AND street > 0) AS postflop_checks,
       count(*) FILTER (y = 2 AND street > 0) AS postflop_calls, count(*) FILTER (street > 0) AS postflop_actions,
       count(*) FILTER (y = 0 AND to_call > 0) AS folds_facing_bet,
       count(*) FILTER (y = 2 AND to_call > 0) AS calls_facing_bet,
       count(*) FILTER (street = 0 AND y >= 2) AS vpip_actions,
       count(*) FILTER (street = 0 AND y = 4) AS preflop_raises,
       sum(amount) AS contribution, max(amount) AS max_amount, max(to_call) AS max_to_call,
       sum(to_call) AS sum_to_call, max(pot_before) AS max_pot_before, min(players_active) AS min_players_active,
       max(to_call) FILTER (y = 0) AS fold_to_call, max(pot_before) FILTER (y = 0) AS fold_pot_before,
       min(street) FILTER (y = 0) AS fold_street, max(street) AS last_street,
       min(action_no) FILTER (y = 0) AS exit_no, max(players_dealt) AS players_dealt, max(strength) AS best,
       max(strength) FILTER (street <= 0) AS str_0, max(strength) FILTER (street <= 1) AS str_1,
       max(strength) FILTER (street <= 2) AS str_2, max(strength) AS str_3
FROM act GROUP BY table_id, phase, started_at, hand_id, player_id""")

cte("seat", """
SELECT s.*, a.folded_to, coalesce(a.folds_induced, 0) AS folds_induced, s.exit_no IS NOT NULL AS folded,
       s.exit_no IS NULL AND last_street = 3 AS went_to_showdown,
       sum(contribution) OVER (PARTITION BY s.hand_id) AS final_pot,
       contribution * players_dealt - sum(contribution) OVER (PARTITION BY s.hand_id) AS net,
       contribution / 10000.0::DOUBLE AS contribution_bb,
       sum(contribution) OVER (PARTITION BY s.hand_id) / 10000.0::DOUBLE AS pot_bb,
       coalesce(fold_pot_before, 0)::DOUBLE / greatest(coalesce(fold_to_call, 0), 1) AS fold_pot_odds,
       (coalesce(str_0, 0) + 1) / 100.0::DOUBLE AS preflop_pct,
       rank() OVER (PARTITION BY s.hand_id ORDER BY best DESC) AS strength_rank,
       (rank() OVER (PARTITION BY s.hand_id ORDER BY best DESC) = 1)::INT AS held_best_hand
FROM seat0 AS s LEFT JOIN attribution AS a ON s.hand_id = a.hand_id AND s.player_id = a.player_id""")

oracle("seat_positions", "$hand_id player_id left_at position", """
SELECT hand_id, player_id, exit_no AS left_at, ((player_id % 15 - table_id % 15) % 15 + 15) % 15 AS position FROM seat""")

oracle("seat_stats", "$hand_id player_id n_actions raises bets calls checks folds aggressive_actions "
       "postflop_aggressive postflop_checks postflop_calls postflop_actions folds_facing_bet calls_facing_bet "
       "vpip_actions preflop_raises contribution max_amount max_to_call sum_to_call max_pot_before "
       "min_players_active fold_to_call fold_pot_before fold_street last_street exit_no ~fold_pot_odds "
       "~contribution_bb net", "SELECT * FROM seat")

cte("tot", """
SELECT hand_id, sum(folded::INT) AS h_folds, sum(aggressive_actions) AS h_aggressive,
       sum(contribution) AS h_contribution, sum(folds_facing_bet) AS h_folds_facing_bet,
       sum(went_to_showdown::INT) AS h_showdowns, sum(n_actions) AS h_actions, max(best) AS h_best,
       sum(preflop_raises) AS h_preflop_raises FROM seat GROUP BY hand_id""")

oracle("hand_totals", "$hand_id h_folds h_aggressive h_contribution h_folds_facing_bet h_showdowns h_actions h_best "
       "h_preflop_raises", "SELECT * FROM tot")

oracle("actor_style", "player_id $phase hands ~vpip_rate ~pfr_rate ~fold_rate ~showdown_rate ~aggression_rate "
       "~postflop_aggression_rate style_actions ~open_raise ~open_fold ~versus_raise_aggressive "
       "~versus_raise_fold ~later_aggressive ~later_fold_to_bet", """
SELECT r.*, s.* EXCLUDE (player_id, phase) FROM (
  SELECT player_id, phase, count(*) AS hands, avg((vpip_actions > 0)::INT) AS vpip_rate,
         avg((preflop_raises > 0)::INT) AS pfr_rate, avg(folded::INT) AS fold_rate,
         avg(went_to_showdown::INT) AS showdown_rate,
         sum(aggressive_actions)::DOUBLE / greatest(sum(n_actions), 1) AS aggression_rate,
         sum(postflop_aggressive)::DOUBLE / greatest(sum(postflop_actions), 1) AS postflop_aggression_rate
  FROM seat GROUP BY 1, 2) AS r
JOIN (
  SELECT player_id, phase, count(*) AS style_actions,
    (count(*) FILTER (street = 0 AND n_agg_st = 0 AND y >= 3) + 1.0) / (count(*) FILTER (street = 0 AND n_agg_st = 0) + 5) AS open_raise,
    (count(*) FILTER (street = 0 AND n_agg_st = 0 AND y = 0) + 3.0) / (count(*) FILTER (street = 0 AND n_agg_st = 0) + 5) AS open_fold,
    (count(*) FILTER (street = 0 AND n_agg_st > 0 AND y >= 3) + 1.0) / (count(*) FILTER (street = 0 AND n_agg_st > 0) + 10) AS versus_raise_aggressive,
    (count(*) FILTER (street = 0 AND n_agg_st > 0 AND y = 0) + 6.0) / (count(*) FILTER (street = 0 AND n_agg_st > 0) + 10) AS versus_raise_fold,
    (count(*) FILTER (street > 0 AND y >= 3) + 3.0) / (count(*) FILTER (street > 0) + 10) AS later_aggressive,
    (count(*) FILTER (street > 0 AND to_call > 0 AND y = 0) + 4.0) / (count(*) FILTER (street > 0 AND to_call > 0) + 10) AS later_fold_to_bet
  FROM act GROUP BY 1, 2) AS s USING (player_id, phase)""")

oracle("strength_rank", "$hand_id player_id best strength_rank held_best_hand str_0 str_1 str_2 str_3",
       "SELECT * FROM seat")

cte("relay", """
SELECT DISTINCT hand_id, least(prev, player_id) AS p1, greatest(prev, player_id) AS p2 FROM (
  SELECT hand_id, player_id, lag(player_id) OVER (PARTITION BY hand_id ORDER BY action_no) AS prev
  FROM log WHERE y >= 3) AS r WHERE prev <> player_id""")

oracle("consecutive_aggression", "$hand_id p1 p2", "SELECT * FROM relay")


def at_street(prefix: str, street: str = "street", suffix: str = "") -> str:
    return f"CASE {street} " + " ".join(f"WHEN {i} THEN {prefix}{i}{suffix}" for i in range(4)) + " END"


cte("conc", f"""
SELECT *, (street > 0 AND folder_strength IS NOT NULL AND aggressor_strength IS NOT NULL)::INT AS comparable,
       coalesce(street > 0 AND folder_strength > aggressor_strength, false)::INT AS better
FROM (SELECT a.hand_id, a.table_id, a.phase, a.street, a.player_id AS folder, a.last_agg AS target,
             a.last_agg_amount / 10000.0 AS to_bet_bb, a.last_agg_street AS to_street,
             {at_street('m.str_', 'a.street')} AS folder_strength,
             {at_street('t.str_', 'a.street')} AS aggressor_strength
      FROM act AS a JOIN seat AS m ON a.hand_id = m.hand_id AND a.player_id = m.player_id
      JOIN seat AS t ON a.hand_id = t.hand_id AND a.last_agg = t.player_id
      WHERE a.is_exit AND a.last_agg IS NOT NULL) AS x""")

oracle("concessions", "$hand_id street folder target ~to_bet_bb to_street folder_strength aggressor_strength comparable "
       "better", "SELECT * FROM conc")

oracle("pair_universe", "$phase table_id p1 p2 shared_hands", """
SELECT a.phase, a.table_id, a.player_id AS p1, b.player_id AS p2, count(*) AS shared_hands
FROM seat AS a JOIN seat AS b ON a.hand_id = b.hand_id AND a.player_id < b.player_id GROUP BY ALL""")

oracle("pair_universe_orders", "$phase table_id p1 p2 shared_hands", """
SELECT 'all' AS phase, a.t AS table_id, a.s AS p1, b.s AS p2, count(*) AS shared_hands
FROM (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s, o_custkey % 10 AS t
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS a
JOIN (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) AS b ON a.o = b.o AND a.s < b.s
GROUP BY ALL""")

oracle("candidate_reconcile", "matched count_differs only_candidates only_given", """
SELECT count(*) FILTER (d.n IS NOT NULL AND e.n IS NOT NULL) AS matched,
       count(*) FILTER (d.n <> e.n) AS count_differs, count(*) FILTER (e.n IS NULL) AS only_candidates,
       count(*) FILTER (d.n IS NULL) AS only_given
FROM (SELECT a.player_id AS p1, b.player_id AS p2, count(*) AS n FROM seat AS a JOIN seat AS b
      ON a.hand_id = b.hand_id AND a.player_id < b.player_id WHERE a.phase = 'development'
      GROUP BY 1, 2 HAVING count(*) >= 12) AS d
FULL JOIN (SELECT a.player_id AS p1, b.player_id AS p2, count(*) AS n FROM seat AS a JOIN seat AS b
      ON a.hand_id = b.hand_id AND a.player_id < b.player_id WHERE a.phase = 'evaluation'
      GROUP BY 1, 2 HAVING count(*) >= 8) AS e ON d.p1 = e.p1 AND d.p2 = e.p2""")

_SIDES = ("net contribution contribution_bb folded went_to_showdown n_actions calls aggressive_actions "
          "postflop_aggressive postflop_checks postflop_actions calls_facing_bet folds_facing_bet vpip_actions "
          "preflop_raises folded_to folds_induced fold_pot_odds fold_street min_players_active strength_rank "
          "held_best_hand best preflop_pct str_0 str_1 str_2 str_3").split()

cte("ph0", "SELECT a.phase, a.table_id, a.hand_id, a.started_at, a.pot_bb, a.players_dealt, a.player_id AS p1, "
    "b.player_id AS p2, " + ", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2" for c in _SIDES)
    + ", t.* EXCLUDE (hand_id), r.p1 IS NOT NULL AS consecutive_aggression"
    " FROM seat AS a JOIN seat AS b ON a.hand_id = b.hand_id AND a.player_id < b.player_id"
    " JOIN tot AS t ON a.hand_id = t.hand_id"
    " LEFT JOIN relay AS r ON a.hand_id = r.hand_id AND a.player_id = r.p1 AND b.player_id = r.p2")

cte("ph1", "SELECT *, " + ", ".join(f"""
coalesce(folded_to_{a} = p{b}, false) AS folded_{a}_to_{b},
coalesce(folded_to_{a} = p{b} AND ({at_street('str_', f'fold_street_{a}', f'_{a}')})
         > ({at_street('str_', f'fold_street_{a}', f'_{b}')}), false) AS ahead_fold_{a}_to_{b},
net_{a} < 0 AND net_{b} > 0 AND best_{a} < best_{b} AND contribution_{a} >= 20000 AS paid_{a}_to_{b},
folded_{a} AND best_{a} > best_{b} AND net_{b} > 0 AND contribution_{a} > 0 AS fold_better_{a}_to_{b},
folded_{a} AND held_best_hand_{a} = 1 AND net_{b} > 0 AS conceded_{a}_to_{b},
least(greatest(-net_{a}, 0), greatest(net_{b}, 0)) AS transfer_{a}_to_{b}""" for a, b in ((1, 2), (2, 1)))
    + " FROM ph0")

cte("ph", """
SELECT *, transfer_1_to_2 + transfer_2_to_1 AS transfer_gross, transfer_1_to_2 - transfer_2_to_1 AS transfer_signed,
  contribution_1 - contribution_2 AS contribution_gap, net_1 - net_2 AS net_gap,
  strength_rank_2 - strength_rank_1 AS strength_gap,
  coalesce(ahead_fold_1_to_2 AND fold_street_1 = 0, false) AS ahead_fold_preflop_1_to_2,
  coalesce(ahead_fold_2_to_1 AND fold_street_2 = 0, false) AS ahead_fold_preflop_2_to_1,
  CASE WHEN ahead_fold_1_to_2 AND fold_street_1 = 0 THEN preflop_pct_1 - preflop_pct_2
       WHEN ahead_fold_2_to_1 AND fold_street_2 = 0 THEN preflop_pct_2 - preflop_pct_1 ELSE 0 END AS ahead_fold_equity_gap,
  CASE WHEN folded_1_to_2 THEN fold_pot_odds_1 ELSE 0 END AS fold_odds_declined_1,
  CASE WHEN folded_2_to_1 THEN fold_pot_odds_2 ELSE 0 END AS fold_odds_declined_2,
  CASE WHEN folded_1_to_2 AND best_1 > best_2 THEN fold_pot_odds_1 * contribution_bb_1 ELSE 0 END AS concession_weight_1,
  CASE WHEN folded_2_to_1 AND best_2 > best_1 THEN fold_pot_odds_2 * contribution_bb_2 ELSE 0 END AS concession_weight_2,
  went_to_showdown_1 AND went_to_showdown_2 AS both_showdown, folded_1 AND folded_2 AS both_folded,
  folded_1 <> folded_2 AS one_folded, NOT folded_1 AND NOT folded_2 AS both_in_pot,
  NOT folded_1 AND NOT folded_2 AND min_players_active_1 <= 2 AND min_players_active_2 <= 2 AS heads_up,
  NOT folded_1 AND NOT folded_2 AND postflop_actions_1 > 0 AND postflop_actions_2 > 0
    AND postflop_aggressive_1 = 0 AND postflop_aggressive_2 = 0 AS mutual_passive,
  aggressive_actions_1 + aggressive_actions_2 AS pair_aggressive,
  h_folds - folded_1::INT - folded_2::INT AS outsider_folds,
  h_aggressive - aggressive_actions_1 - aggressive_actions_2 AS outsider_aggressive,
  h_contribution - contribution_1 - contribution_2 AS outsider_contribution,
  h_folds_facing_bet - folds_facing_bet_1 - folds_facing_bet_2 AS outsider_folds_facing_bet,
  h_showdowns - went_to_showdown_1::INT - went_to_showdown_2::INT AS outsider_showdowns,
  h_preflop_raises - preflop_raises_1 - preflop_raises_2 AS outsider_preflop_raises,
  net_1 + net_2 AS pair_net, -(net_1 + net_2) AS outsider_net,
  folds_induced_1 + folds_induced_2 - folded_1_to_2::INT - folded_2_to_1::INT AS outsiders_folded_to_pair,
  folds_induced_1 - folded_2_to_1::INT AS outsiders_folded_to_p1,
  folds_induced_2 - folded_1_to_2::INT AS outsiders_folded_to_p2,
  aggressive_actions_1 > 0 AND aggressive_actions_2 > 0 AS both_aggressive,
  consecutive_aggression AND h_folds - folded_1::INT - folded_2::INT > 0 AS relay_cleared,
  preflop_raises_1 > 0 AND preflop_raises_2 > 0 AS both_raised_preflop,
  preflop_raises_1 > 0 AND preflop_raises_2 > 0
    AND h_preflop_raises - preflop_raises_1 - preflop_raises_2 > 0 AS squeeze_sandwich,
  preflop_raises_1 * (1 - preflop_pct_1) + preflop_raises_2 * (1 - preflop_pct_2) AS weak_raise_weight,
  CASE WHEN preflop_raises_1 > 0 AND preflop_raises_2 > 0 THEN least(preflop_pct_1, preflop_pct_2) END AS weaker_raiser,
  aggressive_actions_1 > 0 AND aggressive_actions_2 > 0 AND net_1 < 0 AND net_2 < 0 AS aggressive_loss
FROM ph1""")

_K = "$hand_id p1 p2 "
oracle("pair_hands_flow", _K + "transfer_1_to_2 transfer_2_to_1 transfer_gross transfer_signed contribution_gap net_gap "
       "strength_gap", "SELECT * FROM ph")
oracle("transfer_events", _K + " ".join(
    f"{e}_{d}" for e in ("folded", "ahead_fold", "ahead_fold_preflop", "paid", "fold_better", "conceded")
    for d in ("1_to_2", "2_to_1")) + " ~ahead_fold_equity_gap ~fold_odds_declined_1 ~fold_odds_declined_2 "
    "~concession_weight_1 ~concession_weight_2", "SELECT * FROM ph")
oracle("contact_flags", _K + "both_showdown both_folded one_folded both_in_pot heads_up mutual_passive pair_aggressive",
       "SELECT * FROM ph")
oracle("isolation_flags", _K + "both_aggressive consecutive_aggression relay_cleared both_raised_preflop "
       "squeeze_sandwich ~weak_raise_weight ~weaker_raiser aggressive_loss", "SELECT * FROM ph")
oracle("outsider_context", _K + "outsider_folds outsider_aggressive outsider_contribution outsider_folds_facing_bet "
       "outsider_showdowns outsider_preflop_raises pair_net outsider_net outsiders_folded_to_pair "
       "outsiders_folded_to_p1 outsiders_folded_to_p2", "SELECT * FROM ph")

_W = "(net_1 > net_2 OR (net_1 = net_2 AND contribution_1 <= contribution_2))"
oracle("winner_orientation", _K + "W_n_actions L_n_actions W_contribution L_contribution W_best L_best ~flow_bb "
       "~pair_net_bb ~winner_net_bb ~loser_net_bb both_voluntary neither_fold opposite_sign ~max_contribution_bb",
       "SELECT *, " + ", ".join(
           f"CASE WHEN {_W} THEN {c}_1 ELSE {c}_2 END AS W_{c}, CASE WHEN {_W} THEN {c}_2 ELSE {c}_1 END AS L_{c}"
           for c in ("n_actions", "contribution", "best")) + """,
  abs(net_1 - net_2) / (10000.0 * players_dealt) AS flow_bb, (net_1 + net_2) / (10000.0 * players_dealt) AS pair_net_bb,
  greatest(net_1, net_2) / (10000.0 * players_dealt) AS winner_net_bb,
  least(net_1, net_2) / (10000.0 * players_dealt) AS loser_net_bb,
  contribution_1 > 10000 AND contribution_2 > 10000 AS both_voluntary, both_in_pot AS neither_fold,
  sign(net_1) * sign(net_2) < 0 AS opposite_sign,
  greatest(contribution_bb_1, contribution_bb_2) AS max_contribution_bb FROM ph""")

oracle("third_folds", _K + "third_folds", """
SELECT a.hand_id, least(a.last_agg, o.player_id) AS p1, greatest(a.last_agg, o.player_id) AS p2, count(*) AS third_folds
FROM act AS a JOIN seat AS o ON a.hand_id = o.hand_id
WHERE a.y = 0 AND a.last_agg IS NOT NULL AND o.player_id NOT IN (a.player_id, a.last_agg)
  AND (o.exit_no IS NULL OR o.exit_no > a.action_no) GROUP BY 1, 2, 3""")

oracle("isolation_counts", _K + "third_folds ~third_dead_bb folds_after_invest multiway_aggression reraise_over_third "
       "open_raises", """
SELECT coalesce(f.hand_id, g.hand_id) AS hand_id, coalesce(f.p1, g.p1) AS p1, coalesce(f.p2, g.p2) AS p2,
  coalesce(third_folds, 0) AS third_folds, coalesce(third_dead_bb, 0) AS third_dead_bb,
  coalesce(folds_after_invest, 0) AS folds_after_invest, coalesce(multiway_aggression, 0) AS multiway_aggression,
  coalesce(reraise_over_third, 0) AS reraise_over_third, coalesce(open_raises, 0) AS open_raises
FROM (SELECT a.hand_id, least(a.last_agg, o.player_id) AS p1, greatest(a.last_agg, o.player_id) AS p2,
             count(*) AS third_folds, sum(invested_before / 10000.0) AS third_dead_bb,
             count(*) FILTER (invested_before > 10000) AS folds_after_invest
      FROM act AS a JOIN seat AS o ON a.hand_id = o.hand_id
      WHERE a.y = 0 AND a.last_agg IS NOT NULL AND o.player_id NOT IN (a.player_id, a.last_agg)
      GROUP BY 1, 2, 3) AS f
FULL JOIN (SELECT a.hand_id, least(a.player_id, o.player_id) AS p1, greatest(a.player_id, o.player_id) AS p2,
             count(*) FILTER (players_active > 2) AS multiway_aggression,
             count(*) FILTER (last_agg IS NOT NULL AND last_agg NOT IN (o.player_id, a.player_id)) AS reraise_over_third,
             count(*) FILTER (street = 0 AND last_agg IS NULL) AS open_raises
      FROM act AS a JOIN seat AS o ON a.hand_id = o.hand_id
      WHERE a.y >= 3 AND o.player_id <> a.player_id GROUP BY 1, 2, 3) AS g
  ON f.hand_id = g.hand_id AND f.p1 = g.p1 AND f.p2 = g.p2""")

# ---------------------------------------------------------------- policy

cte("state", """
SELECT *, table_id % 5 AS fold, street AS c_street,
       CASE WHEN strength < 34 THEN 0 WHEN strength < 67 THEN 1 ELSE 2 END AS c_own,
       least(n_agg_hand, 2) AS c_agg, (live_opponents + 1 <= 2)::INT AS c_hu,
       CASE WHEN y >= 3 THEN ln(1 + amount::DOUBLE / greatest(pot_before, 1)) END AS size
FROM act""")


def smoothed_policy(source: str, keys: str) -> str:
    n = ", ".join(f"count(*) FILTER (y = {k}) AS n{k}" for k in range(5))
    t = ", ".join(f"sum(n{k}) OVER (PARTITION BY {keys}) AS t{k}" for k in range(5))
    g = ", ".join(f"sum(n{k}) OVER () AS g{k}" for k in range(5))
    den = "(t0 - n0 + t1 - n1 + t2 - n2 + t3 - n3 + t4 - n4 + 10.0)"
    p = ", ".join(f"(t{k} - n{k} + 10.0 * g{k} / (g0 + g1 + g2 + g3 + g4)) / {den} AS p{k}" for k in range(5))
    return (f"SELECT {keys}, fold, {p} FROM (SELECT *, {t}, {g} FROM "
            f"(SELECT {keys}, fold, {n} FROM {source} GROUP BY {keys}, fold) AS c) AS d")


cte("policy", smoothed_policy("state", "c_street, c_own, c_agg, c_hu"))

cte("sized", """
SELECT s.*, (coalesce(ts, 0) - coalesce(sz, 0) + 10 * gm) / (tn - nz + 10) AS size_expected
FROM state AS s JOIN (
  SELECT *, sum(sz) OVER (PARTITION BY c_street, c_hu) AS ts, sum(nz) OVER (PARTITION BY c_street, c_hu) AS tn,
         sum(sz) OVER () / sum(nz) OVER () AS gm
  FROM (SELECT c_street, c_hu, fold, sum(size) AS sz, count(size) AS nz FROM state GROUP BY 1, 2, 3) AS c) AS d
USING (c_street, c_hu, fold)""")

cte("scored", """
SELECT *, p0 AS p_fold, p1 + p2 AS p_pass, p3 + p4 AS p_agg,
       CASE WHEN y = 0 THEN surp ELSE 0 END AS fold_surp, CASE WHEN y = 2 THEN surp ELSE 0 END AS call_surp,
       CASE WHEN y >= 3 THEN surp ELSE 0 END AS aggr_surp, (y >= 3)::INT - (p3 + p4) AS aggr_excess,
       (size - size_expected) / (SELECT stddev_samp(size - size_expected) FROM sized) AS size_z
FROM (SELECT s.*, p.p0, p.p1, p.p2, p.p3, p.p4, -ln(greatest([p.p0, p.p1, p.p2, p.p3, p.p4][y + 1], 1e-9)) AS surp
      FROM sized AS s JOIN policy AS p USING (c_street, c_own, c_agg, c_hu, fold)) AS x""")

oracle("policy_surprisal", "$hand_id action_no ~p0 ~p1 ~p2 ~p3 ~p4 ~surp ~fold_surp ~call_surp ~aggr_surp ~aggr_excess",
       "SELECT * FROM scored")
oracle("size_residual", "$hand_id action_no ~size ~size_expected ~size_z", "SELECT * FROM scored WHERE size IS NOT NULL")
oracle("policy_log_loss", "$phase street n ~log_loss",
       "SELECT phase, street, count(*) AS n, avg(surp) AS log_loss FROM scored GROUP BY 1, 2")

cte("byseat", """
SELECT hand_id, player_id, sum(surp) AS surprise, max(surp) AS surprise_max, avg(surp) AS surprise_mean,
  sum(fold_surp) AS fold_surprise, sum(call_surp) AS call_surprise, sum(aggr_surp) AS aggr_surprise,
  sum(aggr_excess) AS aggression_excess FROM scored GROUP BY 1, 2""")
cte("bytarget", """
SELECT phase, table_id, hand_id, player_id, last_agg AS target, sum(surp) AS surprise, max(surp) AS surprise_max,
  sum(fold_surp) AS fold_surprise, sum(call_surp) AS call_surprise, sum(aggr_surp) AS aggr_surprise,
  sum(aggr_excess) AS aggression_excess, count(*) AS actions, count(*) FILTER (y = 0) AS folds
FROM scored WHERE last_agg IS NOT NULL AND last_agg <> player_id GROUP BY 1, 2, 3, 4, 5""")
oracle("surprise_by_seat", "$hand_id player_id ~surprise ~surprise_max ~surprise_mean ~fold_surprise ~call_surprise "
       "~aggr_surprise ~aggression_excess", "SELECT * FROM byseat")
oracle("surprise_by_target", "$hand_id player_id target ~surprise ~surprise_max ~fold_surprise ~call_surprise "
       "~aggr_surprise ~aggression_excess actions folds", "SELECT * FROM bytarget")

_DC = ["surprise", "fold_surprise", "call_surprise", "aggr_surprise", "actions"]
oracle("directed_pivot", _K + " ".join(f"{'' if c == 'actions' else '~'}{c}_{d}" for c in _DC for d in ("1_to_2", "2_to_1")),
       "SELECT hand_id, least(player_id, target) AS p1, greatest(player_id, target) AS p2, " + ", ".join(
           f"sum(CASE WHEN player_id {op} target THEN {c} ELSE 0 END) AS {c}_{d}"
           for c in _DC for op, d in (("<", "1_to_2"), (">", "2_to_1"))) + " FROM bytarget GROUP BY 1, 2, 3")

cte("live", f"""
SELECT s.*, o.player_id AS opp, {at_street('o.str_', 's.street')} AS opp_str,
       coalesce(s.strength - ({at_street('o.str_', 's.street')}), 0) AS rel,
       coalesce(s.last_agg = o.player_id, false) AS facing
FROM scored AS s JOIN seat AS o ON s.hand_id = o.hand_id AND s.player_id <> o.player_id
WHERE o.exit_no IS NULL OR o.exit_no > s.action_no""")

oracle("live_expansion", "$hand_id action_no player_id opp opp_str rel facing live_opponents opp_rel_position opp_ahead "
       "opp_strength_diff opp_best_live", """
SELECT *, count(*) OVER (PARTITION BY hand_id, action_no) AS live_opponents,
  ((opp % 15 - player_id % 15) % 15 + 15) % 15 AS opp_rel_position, coalesce(opp_str > strength, false) AS opp_ahead,
  opp_str - strength AS opp_strength_diff,
  coalesce(opp_str = max(opp_str) OVER (PARTITION BY hand_id, action_no), false) AS opp_best_live
FROM (SELECT * EXCLUDE (live_opponents) FROM live) AS x""")

oracle("role_measures", "$hand_id player_id opp n_act ~surp_sum ~surp_max ~surp_fold ~surp_pass ~surp_agg ~surp_facing "
       "n_fold_facing rel_fold_facing str_fold_facing str_fold ~chips_behind ~chips_behind_facing ~dump_value "
       "~surp_pass_ahead n_pass_ahead ~soft_value ~fold_value n_agg_multi ~surp_agg_multi ~surp_hu ~size_z_max "
       "~size_z_min n_allin ~chips_in ~surp_post", """
SELECT hand_id, player_id, opp, count(*) AS n_act, sum(surp) AS surp_sum, max(surp) AS surp_max,
  coalesce(sum(surp) FILTER (y = 0), 0) AS surp_fold, coalesce(sum(surp) FILTER (y IN (1, 2)), 0) AS surp_pass,
  coalesce(sum(surp) FILTER (y >= 3), 0) AS surp_agg, coalesce(sum(surp) FILTER (facing), 0) AS surp_facing,
  count(*) FILTER (y = 0 AND facing) AS n_fold_facing, max(rel) FILTER (y = 0 AND facing) AS rel_fold_facing,
  max(strength) FILTER (y = 0 AND facing) AS str_fold_facing, max(strength) FILTER (y = 0) AS str_fold,
  coalesce(sum(amount / 10000.0::DOUBLE) FILTER (rel < 0), 0) AS chips_behind,
  coalesce(sum(amount / 10000.0::DOUBLE) FILTER (rel < 0 AND facing), 0) AS chips_behind_facing,
  sum(amount / 10000.0::DOUBLE * -rel) AS dump_value,
  coalesce(sum(surp) FILTER (y IN (1, 2) AND rel > 0), 0) AS surp_pass_ahead,
  count(*) FILTER (y IN (1, 2) AND rel > 0) AS n_pass_ahead,
  coalesce(sum(pot_before / 10000.0::DOUBLE * rel) FILTER (y IN (1, 2) AND rel > 0), 0) AS soft_value,
  coalesce(sum(pot_before / 10000.0::DOUBLE * rel) FILTER (y = 0), 0) AS fold_value,
  count(*) FILTER (y >= 3 AND players_active > 2) AS n_agg_multi,
  coalesce(sum(surp) FILTER (y >= 3 AND players_active > 2), 0) AS surp_agg_multi,
  coalesce(sum(surp) FILTER (players_active = 2), 0) AS surp_hu,
  max(size_z) FILTER (y >= 3) AS size_z_max, min(size_z) FILTER (y >= 3) AS size_z_min,
  count(*) FILTER (y = 5) AS n_allin, sum(amount / 10000.0::DOUBLE) AS chips_in,
  coalesce(sum(surp) FILTER (street > 0), 0) AS surp_post
FROM live GROUP BY 1, 2, 3""")

cte("hidden_state", """
SELECT * EXCLUDE (c_agg, p0, p1, p2, p3, p4), (last_agg IS NOT NULL)::INT AS c_agg, facing::INT AS c_facing,
       CASE WHEN rel < -10 THEN 0 WHEN rel > 10 THEN 2 ELSE 1 END AS c_rel FROM live""")
cte("hidden_once", "SELECT DISTINCT hand_id, action_no, c_street, c_own, c_agg, y, fold FROM hidden_state")
cte("hidden_plain", smoothed_policy("hidden_once", "c_street, c_own, c_agg"))
cte("hidden_full", smoothed_policy("hidden_state", "c_street, c_own, c_agg, c_facing, c_rel"))
cte("hidden_gain", """
SELECT *, gain - avg(gain) OVER (PARTITION BY hand_id, action_no) AS hi FROM (
  SELECT h.phase, h.table_id, h.hand_id, h.action_no, h.player_id, h.opp, h.y, h.facing,
    ln([f.p0, f.p1, f.p2, f.p3, f.p4][h.y + 1]) - ln([p.p0, p.p1, p.p2, p.p3, p.p4][h.y + 1]) AS gain
  FROM hidden_state AS h JOIN hidden_plain AS p USING (c_street, c_own, c_agg, fold)
  JOIN hidden_full AS f USING (c_street, c_own, c_agg, c_facing, c_rel, fold)) AS x""")
oracle("hidden_information_hand", "$hand_id player_id opp ~hi_sum ~hi_max ~gain_sum ~gain_fold ~gain_facing n", """
SELECT hand_id, player_id, opp, sum(hi) AS hi_sum, max(hi) AS hi_max, sum(gain) AS gain_sum,
  coalesce(sum(gain) FILTER (y = 0), 0) AS gain_fold, coalesce(sum(gain) FILTER (facing), 0) AS gain_facing, count(*) AS n
FROM hidden_gain GROUP BY 1, 2, 3""")
oracle("hidden_information", "$phase table_id actor partner n ~hi_rate ~hi_delta ~hi_excess ~hi_max", """
SELECT *, hi_rate - field AS hi_delta, (hi_rate - field) * sqrt(least(n, 400)) AS hi_excess FROM (
  SELECT *, s / n AS hi_rate, (sum(s) OVER a - s) / greatest(sum(n) OVER a - n, 1) AS field FROM (
    SELECT phase, table_id, player_id AS actor, opp AS partner, sum(hi) AS s, max(hi) AS hi_max, count(*) AS n
    FROM hidden_gain GROUP BY 1, 2, 3, 4) AS x WINDOW a AS (PARTITION BY phase, table_id, actor)) AS y""")

# ---------------------------------------------------------------- surprise on pair-hands, signals

_S = ["surprise", "fold_surprise", "call_surprise", "aggr_surprise", "aggression_excess"]
cte("phs", "SELECT h.*, " + ", ".join(f"coalesce(s{i}.{c}, 0) AS {c}_{i}" for c in _S for i in (1, 2)) + ", "
    + ", ".join(f"coalesce(t{a}.{c}, 0) AS v_{c}_{a}_to_{3 - a}" for c in _S for a in (1, 2))
    + " FROM ph AS h"
    + "".join(f" LEFT JOIN byseat AS s{i} ON h.hand_id = s{i}.hand_id AND h.p{i} = s{i}.player_id" for i in (1, 2))
    + "".join(f" LEFT JOIN bytarget AS t{a} ON h.hand_id = t{a}.hand_id AND h.p{a} = t{a}.player_id"
              f" AND h.p{3 - a} = t{a}.target" for a in (1, 2)))


def _either(e: str) -> str:
    return f"({e}_1_to_2 OR {e}_2_to_1)"


cte("sig0", f"""
SELECT *, surprise_1 + surprise_2 AS pair_surprise, fold_surprise_1 + fold_surprise_2 AS pair_fold_surprise,
  aggression_excess_1 + aggression_excess_2 AS pair_aggr_excess,
  v_surprise_1_to_2 + v_surprise_2_to_1 AS surprise_vs_partner,
  greatest(v_surprise_1_to_2, v_surprise_2_to_1) AS surprise_vs_partner_hi,
  v_fold_surprise_1_to_2 + v_fold_surprise_2_to_1 AS fold_vs_partner,
  v_call_surprise_1_to_2 + v_call_surprise_2_to_1 AS call_vs_partner,
  v_aggr_surprise_1_to_2 + v_aggr_surprise_2_to_1 AS aggr_vs_partner,
  v_aggression_excess_1_to_2 + v_aggression_excess_2_to_1 AS excess_vs_partner,
  CASE WHEN strength_rank_1 <= strength_rank_2 THEN -aggression_excess_1 ELSE -aggression_excess_2 END AS stronger_side_deficit,
  abs(surprise_1 - surprise_2) AS surprise_imbalance, {_either('fold_better')}::INT AS fold_better_flag,
  {_either('paid')}::INT AS paid_flag, {_either('conceded')}::INT AS conceded_flag,
  {_either('ahead_fold')}::INT AS ahead_fold, ({_either('fold_better')} OR {_either('paid')})::INT AS transfer_event,
  greatest(concession_weight_1, concession_weight_2) AS concession_weight,
  (vpip_actions_1 > 0 OR vpip_actions_2 > 0)::INT AS any_vpip,
  (vpip_actions_1 > 0 AND vpip_actions_2 > 0)::INT AS both_vpip,
  (n_actions_1 > 0 AND n_actions_2 > 0 AND aggressive_actions_1 + aggressive_actions_2 + calls_1 + calls_2 > 0)::INT AS interacted,
  (folded_1_to_2 OR folded_2_to_1 OR (vpip_actions_1 > 0 AND vpip_actions_2 > 0))::INT AS contact,
  coalesce(weaker_raiser, 1) AS weaker_raiser_strength, abs(transfer_signed) AS abs_transfer,
  abs(net_gap) AS abs_net_gap, abs(strength_gap) AS abs_strength_gap,
  CASE WHEN {_either('paid')} THEN transfer_gross ELSE 0 END AS value_against_strength,
  least(strength_rank_1, strength_rank_2) AS min_strength_rank,
  greatest(strength_rank_1, strength_rank_2) AS max_strength_rank,
  postflop_checks_1 + postflop_checks_2 AS postflop_checks_both,
  CASE WHEN net_1 < net_2 THEN contribution_1 ELSE contribution_2 END AS loser_contribution,
  (net_1 > 0 OR net_2 > 0)::INT AS winner_is_partner,
  CASE WHEN net_1 <= net_2 THEN strength_rank_1 ELSE strength_rank_2 END AS donor_weakness,
  CASE WHEN net_1 <= net_2 THEN strength_rank_2 ELSE strength_rank_1 END AS receiver_weakness,
  CASE WHEN net_1 <= net_2 THEN surprise_1 ELSE surprise_2 END AS donor_surprise,
  CASE WHEN net_1 <= net_2 THEN surprise_2 ELSE surprise_1 END AS receiver_surprise,
  CASE WHEN net_1 <= net_2 THEN contribution_1 ELSE contribution_2 END AS donor_contribution,
  CASE WHEN net_1 <= net_2 THEN calls_facing_bet_1 ELSE calls_facing_bet_2 END AS donor_calls,
  (surprise_1 + surprise_2) / (n_actions_1 + n_actions_2 + 1) AS surprise_per_action,
  CASE WHEN outsider_folds > 0 THEN outsiders_folded_to_pair::DOUBLE / outsider_folds ELSE 0 END AS outsider_clear_rate,
  ((aggressive_actions_1 > 0 AND strength_rank_1 >= 4) OR (aggressive_actions_2 > 0 AND strength_rank_2 >= 4))::INT AS aggr_with_weak_hand,
  ((net_1 > 0 OR net_2 > 0) AND pot_bb < 40)::INT AS won_small_pot
FROM phs""")

cte("sig", """
SELECT *, donor_contribution * donor_weakness / 6.0::DOUBLE AS unjustified_investment,
  round(pair_surprise, 6) AS score, round(surprise_vs_partner, 6) AS score2,
  row_number() OVER (PARTITION BY phase, table_id, p1, p2 ORDER BY started_at, hand_id) AS pair_rn
FROM sig0""")

oracle("hand_signals", _K + "~pair_surprise ~pair_fold_surprise ~surprise_vs_partner ~surprise_vs_partner_hi "
       "~fold_vs_partner ~call_vs_partner ~aggr_vs_partner ~excess_vs_partner ~pair_aggr_excess "
       "~stronger_side_deficit ~surprise_imbalance fold_better_flag paid_flag conceded_flag ahead_fold transfer_event "
       "~concession_weight any_vpip both_vpip interacted contact ~weaker_raiser_strength abs_transfer abs_net_gap "
       "abs_strength_gap value_against_strength min_strength_rank max_strength_rank postflop_checks_both "
       "loser_contribution winner_is_partner donor_weakness receiver_weakness ~donor_surprise ~receiver_surprise "
       "donor_contribution donor_calls ~surprise_per_action ~outsider_clear_rate aggr_with_weak_hand "
       "~unjustified_investment won_small_pot", "SELECT * FROM sig")

# ---------------------------------------------------------------- relational statistics

_OWN = "CASE WHEN strength < 34 THEN 0 WHEN strength < 67 THEN 1 ELSE 2 END"
_HU = "count(*) OVER (PARTITION BY hand_id, action_no) = 1"
cte("x96", f"""
SELECT *, y AS act, street * 24 + ({_OWN}) * 8 + coalesce(opp_str > strength, false)::INT * 4 + facing::INT * 2
       + ({_HU})::INT AS ctx FROM live""")
cte("cells96", """
SELECT *, ln(p_here / p_rest) AS lr, p_here - p_rest AS dp FROM (
  SELECT *, (n + 0.5) / (t + 3.0) AS p_here, (n_all - n + 0.5) / (t_all - t + 3.0) AS p_rest FROM (
    SELECT c.*, sum(n) OVER (PARTITION BY phase, table_id, player_id, opp, ctx) AS t,
           sum(n) OVER (PARTITION BY phase, table_id, player_id, ctx, act) AS n_all,
           sum(n) OVER (PARTITION BY phase, table_id, player_id, ctx) AS t_all
    FROM (SELECT phase, table_id, player_id, opp, ctx, act, count(*) AS n FROM x96 GROUP BY ALL) AS c) AS d) AS e""")
oracle("relational_cells", "$phase player_id opp ctx act n t n_all t_all ~lr ~dp", "SELECT * FROM cells96")


def g_statistic(cells: str, keys: str) -> str:
    ahead, facing, hu = "(ctx // 4) % 2 = 1", "(ctx // 2) % 2 = 1", "ctx % 2 = 1"

    def dev(kind: str, where: str) -> str:
        return (f"coalesce(sum(n * dp) FILTER ({kind} AND {where}), 0) "
                f"/ greatest(coalesce(sum(n) FILTER ({where}), 0), 1)")

    return f"""SELECT {keys}, player_id AS actor, opp AS partner, 2 * sum(n * lr) AS g,
  coalesce(2 * sum(n * lr) FILTER ({ahead}), 0) AS g_ahead,
  coalesce(2 * sum(n * lr) FILTER (NOT ({ahead})), 0) AS g_behind,
  coalesce(2 * sum(n * lr) FILTER ({facing}), 0) AS g_facing, coalesce(2 * sum(n * lr) FILTER ({hu}), 0) AS g_heads_up,
  {dev('act = 0', ahead)} AS fold_ahead_dev, {dev('act = 2', f'NOT ({ahead})')} AS call_behind_dev,
  {dev('act >= 3', facing)} AS aggr_facing_dev, sum(n) AS n, count(DISTINCT ctx) AS contexts,
  {dev('act = 0', 'true')} AS fold_dev, {dev('act = 2', 'true')} AS call_dev, {dev('act >= 3', 'true')} AS aggr_dev,
  max(n * lr) AS cell_max, 2 * sum(n * lr) / sum(n) AS g_per_action
FROM {cells} GROUP BY {keys}, player_id, opp"""


cte("gstat", g_statistic("cells96", "phase, table_id"))
_G = ["g", "g_per_action", "n", "fold_dev", "call_dev", "aggr_dev", "cell_max", "g_ahead", "g_behind", "g_facing",
      "g_heads_up", "fold_ahead_dev", "call_behind_dev", "aggr_facing_dev"]
_D = "$phase table_id actor partner "
_P = "$phase table_id p1 p2 "
oracle("relational_g", _D + "~g ~g_ahead ~g_behind ~g_facing ~g_heads_up ~fold_ahead_dev ~call_behind_dev "
       "~aggr_facing_dev n contexts ~fold_dev ~call_dev ~aggr_dev ~cell_max ~g_per_action", "SELECT * FROM gstat")


def folded(source: str, cols: list[str], keys: str = "phase, table_id", sums: list[str] = [], lows: bool = True) -> str:
    out = [f"max({c}) AS {c}_hi" for c in cols] + ([f"min({c}) AS {c}_lo" for c in cols] if lows else [])
    out += [f"sum({c}) AS {c}_sum" for c in sums]
    return (f"SELECT {keys}, least(actor, partner) AS p1, greatest(actor, partner) AS p2, {', '.join(out)} "
            f"FROM {source} GROUP BY {keys}, least(actor, partner), greatest(actor, partner)")


def folded_spec(cols: list[str], sums: list[str] = [], ints: tuple[str, ...] = ()) -> str:
    mark = lambda c: "" if c in ints else "~"
    return " ".join([f"{mark(c)}{c}_{e}" for e in ("hi", "lo") for c in cols] + [f"{mark(c)}{c}_sum" for c in sums])


_HS = ["hi_sum", "gain_sum", "gain_fold", "gain_facing"]
_HC = [*_HS, "hot", "hand_max", *[f"{c}_{f}" for c in _HS for f in ("rate", "delta", "excess")], "hot_rate", "hot_delta"]
cte("hidden_hand", """
SELECT phase, table_id, hand_id, player_id, opp, sum(hi) AS hi_sum, sum(gain) AS gain_sum,
  coalesce(sum(gain) FILTER (y = 0), 0) AS gain_fold, coalesce(sum(gain) FILTER (facing), 0) AS gain_facing, count(*) AS n
FROM hidden_gain GROUP BY 1, 2, 3, 4, 5""")
cte("hidden_directed", "SELECT *, " + ", ".join(f"{c}_delta * sqrt(least(n, 400)) AS {c}_excess" for c in _HS) + " FROM (SELECT *, " + ", ".join(
    f"{c} / greatest(n, 1) AS {c}_rate, {c} / greatest(n, 1) - (sum({c}) OVER a - {c}) / greatest(sum(n) OVER a - n, 1) AS {c}_delta" for c in _HS)
    + """, hot::DOUBLE / greatest(hands, 1) AS hot_rate,
  hot::DOUBLE / greatest(hands, 1) - (sum(hot) OVER a - hot)::DOUBLE / greatest(sum(hands) OVER a - hands, 1) AS hot_delta FROM (
    SELECT phase, table_id, player_id AS actor, opp AS partner, """ + ", ".join(f"sum({c}) AS {c}" for c in _HS) + """, sum(n) AS n, count(*) AS hands,
      count(*) FILTER (round(hi_sum, 9) > 0.1) AS hot, max(hi_sum) AS hand_max FROM hidden_hand GROUP BY 1, 2, 3, 4) AS d
  WINDOW a AS (PARTITION BY phase, table_id, actor)) AS e""")
oracle("hidden_information_pair", _P + folded_spec(_HC, ints=("hot",)), folded("hidden_directed", _HC))

cte("gpair", folded("gstat", _G, sums=["g"]))
oracle("relational_pair", _P + folded_spec(_G, ["g"], ("n",)), "SELECT * FROM gpair")
oracle("relational_hand", "$hand_id player_id opp ~rel_lr ~rest_nll acts", """
SELECT x.hand_id, x.player_id, x.opp, sum(c.lr) AS rel_lr, sum(-ln(c.p_rest)) AS rest_nll, count(*) AS acts
FROM x96 AS x JOIN cells96 AS c USING (phase, table_id, player_id, opp, ctx, act) GROUP BY 1, 2, 3""")

cte("x96b", """SELECT x.*, (t_order - 1) * 4 // table_hands AS block FROM x96 AS x JOIN
  (SELECT hand_id, t_order, table_hands FROM hand_order) AS h USING (hand_id)""")
cte("cells96b", """
SELECT *, ln(p_here / p_rest) AS lr, p_here - p_rest AS dp FROM (
  SELECT *, (n + 0.5) / (t + 3.0) AS p_here, (n_all - n + 0.5) / (t_all - t + 3.0) AS p_rest FROM (
    SELECT c.*, sum(n) OVER (PARTITION BY phase, table_id, block, player_id, opp, ctx) AS t,
           sum(n) OVER (PARTITION BY phase, table_id, block, player_id, ctx, act) AS n_all,
           sum(n) OVER (PARTITION BY phase, table_id, block, player_id, ctx) AS t_all
    FROM (SELECT phase, table_id, block, player_id, opp, ctx, act, count(*) AS n FROM x96b GROUP BY ALL) AS c) AS d) AS e""")
cte("gstatb", g_statistic("cells96b", "phase, table_id, block"))
_B = ["g_hi", "g_lo", "g_sum", "aggr_dev_hi", "fold_dev_hi"]
oracle("relational_blocks", _P + " ".join(f"~blk_{c}_{f}" for f in ("sum", "max") for c in _B) + " blk_n",
       "SELECT phase, table_id, p1, p2, " + ", ".join(f"{f}({c}) AS blk_{c}_{f}" for f in ("sum", "max") for c in _B)
       + ", count(*) AS blk_n FROM (" + folded("gstatb", ["g", "aggr_dev", "fold_dev"], "phase, table_id, block", ["g"])
       + ") AS q GROUP BY 1, 2, 3, 4")

cte("x216", f"""
SELECT *, CASE WHEN y = 0 THEN 0 WHEN y <= 2 THEN 1 ELSE 2 END AS act,
  CASE WHEN last_agg IS NULL THEN 0 WHEN last_agg = player_id THEN 1 WHEN facing THEN 2 ELSE 3 END AS face,
  ({_HU})::INT AS hu,
  (((least(street, 2) * 3 + ({_OWN})) * 3 + CASE WHEN rel < -10 THEN 0 WHEN rel > 10 THEN 2 ELSE 1 END) * 4
   + CASE WHEN last_agg IS NULL THEN 0 WHEN last_agg = player_id THEN 1 WHEN facing THEN 2 ELSE 3 END) * 2
   + ({_HU})::INT AS ctx FROM live""")
cte("cells216", """
SELECT *, (n_ab_act + 3 * p_a) / (n_ab + 3) AS p_ab FROM (
  SELECT *, (n_a_act - n_ab_act + 10 * p0) / (n_a - n_ab + 10) AS p_a FROM (
    SELECT t.*, k.act, coalesce(c.n, 0) AS n_ab_act, coalesce(a.n, 0) AS n_a_act, b.n AS n_a, coalesce(z.p0, 1e-3) AS p0
    FROM (SELECT phase, table_id, player_id, opp, ctx, count(*) AS n_ab FROM x216 GROUP BY ALL) AS t
    CROSS JOIN (SELECT unnest([0, 1, 2]) AS act) AS k
    LEFT JOIN (SELECT phase, table_id, player_id, opp, ctx, act, count(*) AS n FROM x216 GROUP BY ALL) AS c
      USING (phase, table_id, player_id, opp, ctx, act)
    LEFT JOIN (SELECT phase, table_id, player_id, ctx, act, count(*) AS n FROM x216 GROUP BY ALL) AS a
      USING (phase, table_id, player_id, ctx, act)
    LEFT JOIN (SELECT phase, table_id, player_id, ctx, count(*) AS n FROM x216 GROUP BY ALL) AS b
      USING (phase, table_id, player_id, ctx)
    LEFT JOIN (SELECT ctx, act, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY ctx) AS p0 FROM x216 GROUP BY 1, 2) AS z
      USING (ctx, act)) AS u) AS v""")
oracle("relational_shrunk", _P + "~g_hi ~g_lo ~g_sum opportunities ~g_rate", """
SELECT phase, table_id, least(actor, partner) AS p1, greatest(actor, partner) AS p2, max(g) AS g_hi, min(g) AS g_lo,
       sum(g) AS g_sum, sum(o) AS opportunities, sum(g) / sum(o) AS g_rate
FROM (SELECT phase, table_id, player_id AS actor, opp AS partner, sum(n_ab_act * ln(p_ab / p_a)) AS g, sum(n_ab) / 3 AS o
      FROM cells216 GROUP BY 1, 2, 3, 4) AS d GROUP BY 1, 2, 3, 4""")
oracle("relational_loo", "$hand_id player_id opp ~llr_sum ~llr_max ~llr_pos ~llr_face_partner ~llr_face_third "
       "~llr_heads_up ~llr_later ~llr_fold ~llr_pass ~llr_aggr", """
SELECT hand_id, player_id, opp, sum(llr) AS llr_sum, max(llr) AS llr_max, sum(greatest(llr, 0)) AS llr_pos,
  coalesce(sum(llr) FILTER (face = 2), 0) AS llr_face_partner, coalesce(sum(llr) FILTER (face = 3), 0) AS llr_face_third,
  coalesce(sum(llr) FILTER (hu = 1), 0) AS llr_heads_up, coalesce(sum(llr) FILTER (street > 0), 0) AS llr_later,
  coalesce(sum(llr) FILTER (act = 0), 0) AS llr_fold, coalesce(sum(llr) FILTER (act = 1), 0) AS llr_pass,
  coalesce(sum(llr) FILTER (act = 2), 0) AS llr_aggr
FROM (SELECT x.*, ln(((greatest(n_ab_act - 1, 0) + 3 * p_a) / (greatest(n_ab - 1, 0) + 3)) / p_a) AS llr
      FROM x216 AS x JOIN cells216 AS c USING (phase, table_id, player_id, opp, ctx, act)) AS d GROUP BY 1, 2, 3""")

_EV = ["transfer_event", "fold_better", "paid", "folded", "outsider_folds", "ahead_fold"]
cte("cnt", "SELECT phase, table_id, p1, p2, count(*) AS shared_hands, " + ", ".join(f"""
  count(*) FILTER (fold_better_{d} OR paid_{d}) AS k_transfer_event_{s}, count(*) FILTER (fold_better_{d}) AS k_fold_better_{s},
  count(*) FILTER (paid_{d}) AS k_paid_{s}, count(*) FILTER (folded_{d}) AS k_folded_{s},
  sum(outsiders_folded_to_p{s[0]}) AS k_outsider_folds_{s}, count(*) FILTER (ahead_fold_{d}) AS k_ahead_fold_{s}"""
    for d, s in (("1_to_2", "12"), ("2_to_1", "21"))) + " FROM ph GROUP BY 1, 2, 3, 4")
oracle("pair_event_counts", _P + "shared_hands " + " ".join(f"k_{e}_{s}" for s in ("12", "21") for e in _EV),
       "SELECT * FROM cnt")


def binomial_tail(k: str, n: str, p: str) -> str:
    term = (f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))")
    return (f"CASE WHEN {k} <= 0 THEN 0 WHEN {k} > {n} THEN 300 ELSE -log10(least(greatest("
            f"list_sum(list_transform(generate_series(CAST({k} AS BIGINT), CAST({n} AS BIGINT)), "
            f"lambda i: {term})), 1e-300), 1)) END")


cte("dir0", "SELECT *, " + ", ".join(
    f"least(greatest((sum(k_{e}) OVER a - k_{e})::DOUBLE / greatest(sum(n) OVER a - n, 1), 1e-6), 1 - 1e-6) AS field_{e}"
    for e in _EV) + " FROM (" + " UNION ALL ".join(
        f"SELECT phase, table_id, {x} AS actor, {z} AS partner, shared_hands AS n, "
        + ", ".join(f"k_{e}_{s} AS k_{e}" for e in _EV) + " FROM cnt"
        for x, z, s in (("p1", "p2", "12"), ("p2", "p1", "21")))
    + ") AS u WINDOW a AS (PARTITION BY phase, table_id, actor)")
cte("dir", "SELECT *, " + ", ".join(f"""
  {binomial_tail(f'k_{e}', 'n', f'field_{e}')} AS s_{e}, k_{e} - n * field_{e} AS exc_{e}, k_{e}::DOUBLE / greatest(n, 1) AS rate_{e},
  (k_{e} - n * field_{e}) / sqrt(greatest(n * field_{e} * (1 - field_{e}), 1e-9)) AS z_{e}""" for e in _EV) + " FROM dir0")
oracle("binomial_surprise", _D + "n " + " ".join(f"~{s}_{e}" for e in _EV for s in ("s", "z", "exc", "rate")),
       "SELECT * FROM dir")
_BC = [f"{s}_{e}" for e in _EV for s in ("s", "z", "exc", "rate", "field")]
cte("dirpair", folded("dir", _BC, sums=[f"s_{e}" for e in _EV]))
oracle("binomial_surprise_pair", _P + folded_spec(_BC, [f"s_{e}" for e in _EV]), "SELECT * FROM dirpair")
oracle("top_pairs", _P + "shared_hands ~s_transfer_event_hi ~s_folded_hi ~s_outsider_folds_hi ~z_transfer_event_hi "
       "~s_transfer_event_sum", "SELECT d.*, c.shared_hands FROM dirpair AS d JOIN cnt AS c USING (phase, table_id, p1, p2)")

# ---------------------------------------------------------------- pair aggregate and what reads it


def _rate(c: str) -> str:
    return f"avg(({c})::INT)"


_EVENT = "(fold_better_1_to_2 OR fold_better_2_to_1 OR paid_1_to_2 OR paid_2_to_1)"
_AGG = {
    "~ahead_fold_rate": _rate("ahead_fold_1_to_2 OR ahead_fold_2_to_1"),
    "~ahead_fold_preflop_rate": _rate("ahead_fold_preflop_1_to_2 OR ahead_fold_preflop_2_to_1"),
    "~ahead_fold_equity_sum": "sum(ahead_fold_equity_gap)", "flow_12": "sum(transfer_1_to_2)",
    "flow_21": "sum(transfer_2_to_1)", "~transfer_mean": "avg(transfer_gross)", "transfer_max": "max(transfer_gross)",
    "transfer_total": "sum(transfer_gross)", "~transfer_any_rate": _rate("transfer_gross > 0"),
    "~transfer_event_rate": _rate(_EVENT), "transfer_event_n": f"count(*) FILTER ({_EVENT})",
    "~paid_rate": _rate("paid_1_to_2 OR paid_2_to_1"), "~fold_better_rate": _rate("fold_better_1_to_2 OR fold_better_2_to_1"),
    "~conceded_rate": _rate("conceded_1_to_2 OR conceded_2_to_1"),
    "~event_size": f"avg(transfer_gross) FILTER ({_EVENT})",
    "event_value": f"coalesce(sum(transfer_gross) FILTER ({_EVENT}), 0)",
    "~event_pot": f"avg(pot_bb) FILTER ({_EVENT})", "event_max": f"coalesce(max(transfer_gross) FILTER ({_EVENT}), 0)",
    "~surprise_max": "max(surprise_1 + surprise_2)", "~surprise_mean": "avg(surprise_1 + surprise_2)",
    "~surprise_sum": "sum(surprise_1 + surprise_2)", "~fold_surprise_max": "max(fold_surprise_1 + fold_surprise_2)",
    "~fold_surprise_sum": "sum(fold_surprise_1 + fold_surprise_2)",
    "~surprise_imbalance_max": "max(abs(surprise_1 - surprise_2))",
    "~aggression_excess_sum": "sum(aggression_excess_1 + aggression_excess_2)",
    "~surprise_on_events": f"avg(surprise_1 + surprise_2) FILTER ({_EVENT})",
    "~surprise_on_events_max": f"coalesce(max(surprise_1 + surprise_2) FILTER ({_EVENT}), 0)",
    "~both_showdown_rate": _rate("both_showdown"), "~both_in_pot_rate": _rate("both_in_pot"),
    "~heads_up_rate": _rate("heads_up"), "~mutual_passive_rate": _rate("mutual_passive"),
    "~one_folded_rate": _rate("one_folded"),
    "~strong_check_rate": _rate("heads_up AND ((strength_rank_1 = 1 AND postflop_aggressive_1 = 0) OR (strength_rank_2 = 1 AND postflop_aggressive_2 = 0))"),
    "~showdown_loss_rate": _rate("both_showdown AND sign(net_1) * sign(net_2) < 0"),
    "~pair_aggressive_mean": "avg(pair_aggressive)", "~contribution_gap_mean": "avg(abs(contribution_gap))",
    "~net_gap_mean": "avg(abs(net_gap))", "~both_raised_rate": _rate("both_raised_preflop"),
    "both_raised_n": "count(*) FILTER (both_raised_preflop)", "~squeeze_rate": _rate("squeeze_sandwich"),
    "squeeze_n": "count(*) FILTER (squeeze_sandwich)", "~weak_raise_mean": "avg(weak_raise_weight)",
    "~weakest_double_raise": "max(1 - weaker_raiser)", "~aggressive_loss_rate": _rate("aggressive_loss"),
    "~relay_rate": _rate("consecutive_aggression"), "relay_n": "count(*) FILTER (consecutive_aggression)",
    "~relay_cleared_rate": _rate("relay_cleared"), "relay_cleared_n": "count(*) FILTER (relay_cleared)",
    "~both_aggressive_rate": _rate("both_aggressive"), "~pair_net_mean": "avg(pair_net)", "pair_net_total": "sum(pair_net)",
    "~outsider_net_mean": "avg(outsider_net)", "~pair_net_when_relay": "avg(pair_net) FILTER (consecutive_aggression)",
    "~concession_max_1": "max(concession_weight_1)", "~concession_max_2": "max(concession_weight_2)",
    "~concession_sum_1": "sum(concession_weight_1)", "~concession_sum_2": "sum(concession_weight_2)",
    "~fold_odds_max_1": "max(fold_odds_declined_1)", "~fold_odds_max_2": "max(fold_odds_declined_2)",
    "~outsiders_folded_mean": "avg(outsiders_folded_to_pair)", "outsiders_folded_n": "sum(outsiders_folded_to_pair)",
    "~outsiders_folded_both_in": "avg(outsiders_folded_to_pair) FILTER (both_in_pot)",
    "~outsider_folds_mean": "avg(outsider_folds)", "~outsider_aggressive_mean": "avg(outsider_aggressive)",
    "~outsider_contribution_mean": "avg(outsider_contribution)", "~pot_mean": "avg(pot_bb)",
    "~pot_when_transfer": "avg(pot_bb) FILTER (transfer_gross > 0)",
    "~transfer_top3": topk("transfer_gross", 3), "~transfer_top5": topk("transfer_gross", 5),
    "~surprise_top3": topk("(surprise_1 + surprise_2)", 3), "~surprise_top5": topk("(surprise_1 + surprise_2)", 5),
    "~fold_surprise_top3": topk("(fold_surprise_1 + fold_surprise_2)", 3),
    "~weak_raise_top5": topk("weak_raise_weight", 5), "~concession_top3_1": topk("concession_weight_1", 3),
    "~concession_top3_2": topk("concession_weight_2", 3),
    "~event_top3": topk(f"(CASE WHEN {_EVENT} THEN transfer_gross ELSE 0 END)", 3),
    "~transfer_p95": nearest("transfer_gross", 0.95),
    **{f"given_{s}_n": f"count(*) FILTER (fold_better_{d} OR paid_{d})" for s, d in (("12", "1_to_2"), ("21", "2_to_1"))}}
_AGG2 = {
    "transfer_hi_n": "greatest(given_12_n, given_21_n)",
    "~transfer_oneway": "abs(given_12_n - given_21_n) / (given_12_n + given_21_n + 1e-9)",
    "flow_hi": "greatest(flow_12, flow_21)", "flow_imbalance": "abs(flow_12 - flow_21)",
    "~flow_oneway": "abs(flow_12 - flow_21) / (flow_12 + flow_21 + 1e-9)",
    "~top5_share": "transfer_top5 * 5 / (transfer_total + 1e-9)", "~peakiness": "transfer_max / (transfer_mean + 1e-9)",
    "~transfer_per_hand": "transfer_total / shared_hands", "~event_value_share": "event_value / (transfer_total + 1e-9)",
    "~concession_max_hi": "greatest(concession_max_1, concession_max_2)",
    "~concession_sum_hi": "greatest(concession_sum_1, concession_sum_2)",
    "~concession_sum_both": "concession_sum_1 + concession_sum_2",
    "~concession_top3_hi": "greatest(concession_top3_1, concession_top3_2)",
    "~fold_odds_max_hi": "greatest(fold_odds_max_1, fold_odds_max_2)",
    "~concession_per_hand": "greatest(concession_sum_1, concession_sum_2) / shared_hands",
    "~event_span_ratio": "(e1 - e0) / (seen1 - seen0 + 1.0)"}
cte("agg", "SELECT *, " + ", ".join(f"{v} AS {k.lstrip('~')}" for k, v in _AGG2.items())
    + " FROM (SELECT phase, table_id, p1, p2, count(*) AS shared_hands, "
    + ", ".join(f"{v} AS {k.lstrip('~')}" for k, v in _AGG.items())
    + f", min(started_at) AS seen0, max(started_at) AS seen1, min(started_at) FILTER ({_EVENT}) AS e0, "
      f"max(started_at) FILTER ({_EVENT}) AS e1 FROM phs GROUP BY 1, 2, 3, 4) AS base")
oracle("pair_aggregate", _P + "shared_hands " + " ".join([*_AGG, *_AGG2]), "SELECT * FROM agg")

_RATES = ["transfer_event_rate", "both_showdown_rate", "mutual_passive_rate", "both_aggressive_rate", "relay_rate",
          "squeeze_rate", "pair_net_mean", "outsiders_folded_mean", "transfer_per_hand", "one_folded_rate",
          "heads_up_rate", "relay_cleared_rate", "both_raised_rate", "aggressive_loss_rate", "ahead_fold_rate"]
oracle("eb_contrast", _P + folded_spec([f"d_{r}" for r in _RATES]), folded(
    "(SELECT *, " + ", ".join(
        f"({r} - (sum({r} * n) OVER a - {r} * n) / (sum(n) OVER a - n + 1e-9)) * n / (n + 25.0) AS d_{r}" for r in _RATES)
    + " FROM (" + " UNION ALL ".join(
        f"SELECT phase, table_id, {x} AS actor, {z} AS partner, shared_hands AS n, {', '.join(_RATES)} FROM agg"
        for x, z in (("p1", "p2"), ("p2", "p1")))
    + ") AS u WINDOW a AS (PARTITION BY phase, table_id, actor)) AS d", [f"d_{r}" for r in _RATES]))


def _gap(x: str, by: str) -> str:
    return (f"{x} / greatest({by}, 1) - (sum({x}) OVER a - {x}) / greatest(sum({by}) OVER a - {by}, 1)")


cte("contrast", f"""
SELECT *, sv_delta * sqrt(least(actions, 400)) AS sv_excess, fs_delta * sqrt(least(folds, 200)) AS fs_excess,
       cs_delta * sqrt(least(actions, 400)) AS cs_excess FROM (
  SELECT *, {_gap('sv', 'actions')} AS sv_delta, {_gap('ax', 'actions')} AS ax_delta, {_gap('fs', 'folds')} AS fs_delta,
         {_gap('cs', 'actions')} AS cs_delta, sv / greatest(actions, 1) AS sv_per_action, ax / greatest(actions, 1) AS ax_per_action,
         fs / greatest(folds, 1) AS fs_per_fold, (sum(sv) OVER a - sv) / greatest(sum(actions) OVER a - actions, 1) AS sv_field_rate FROM (
    SELECT phase, table_id, player_id AS actor, target AS partner, sum(surprise) AS sv, max(surprise) AS sv_max,
      max(surprise_max) AS sv_action_max, sum(actions) AS actions, sum(aggression_excess) AS ax,
      sum(fold_surprise) AS fs, max(fold_surprise) AS fs_max, sum(call_surprise) AS cs, sum(aggr_surprise) AS ars,
      sum(folds) AS folds FROM bytarget GROUP BY 1, 2, 3, 4) AS d
  WINDOW a AS (PARTITION BY phase, table_id, actor)) AS e""")
_CC = ["sv", "sv_max", "sv_action_max", "actions", "sv_delta", "sv_excess", "ax", "ax_delta", "fs", "fs_max",
       "fs_delta", "fs_excess", "cs", "cs_delta", "cs_excess", "ars", "sv_per_action", "sv_field_rate", "ax_per_action", "fs_per_fold"]
oracle("surprise_contrast", _D + " ".join(c if c == "actions" else f"~{c}" for c in _CC), "SELECT * FROM contrast")
_CS = ["sv_excess", "sv_delta", "ax_delta", "fs_excess", "cs_excess"]
oracle("surprise_contrast_pair", _P + folded_spec(_CC, _CS, ("actions",)), folded("contrast", _CC, sums=_CS))


def residual(classes: int) -> str:
    if classes == 3:
        obs, ps = ["y = 0", "y IN (1, 2)", "y >= 3"], ["p_fold", "p_pass", "p_agg"]
    else:
        obs, ps = [f"y = {k}" for k in range(6)], [f"p{k}" for k in range(5)] + ["0.0::DOUBLE"]
    both = list(enumerate(zip(obs, ps, strict=True)))
    last = classes - 1
    nll = " + ".join(f"CASE WHEN {o} THEN -ln(greatest({p}, 1e-9)) ELSE 0 END" for _, (o, p) in both)
    ent = " + ".join(f"-({p}) * ln(greatest({p}, 1e-12))" for _, (o, p) in both)
    sums = ", ".join(f"""count(*) FILTER ({o}) AS o{i}, sum({p}) AS e{i}, sum({p} * (1 - {p})) AS v{i},
      count(*) FILTER (({o}) AND facing) AS of{i}, coalesce(sum({p}) FILTER (facing), 0) AS ef{i},
      coalesce(sum({p} * (1 - {p})) FILTER (facing), 0) AS vf{i}""" for i, (o, p) in both)
    probs = ", ".join(f"(o{i} + 0.5) / (n + {classes * 0.5}) AS po{i}, (e{i} + 0.5) / (n + {classes * 0.5}) AS pm{i}"
                      for i in range(classes))
    g = " + ".join(f"po{i} * ln(po{i} / pm{i})" for i in range(classes))
    devs = ", ".join(f"(o{i} - e{i}) / n AS dev{i}, (o{i} - e{i}) / sqrt(greatest(v{i}, 1)) AS z{i}" for i in range(classes))
    return f"""SELECT *, 2 * n * ({g}) AS g, greatest(2 * n * ({g}), 0) / (2 * ln(10)) AS g_tail, 2 * ({g}) AS g_per_action,
  nll / n AS surp, (nll - ent) / n AS surp_excess, {devs}, (of0 - ef0) / sqrt(greatest(vf0, 1)) AS z0_facing,
  (of{last} - ef{last}) / sqrt(greatest(vf{last}, 1)) AS z{last}_facing,
  (of{last} - ef{last}) / greatest(n_facing, 1) AS dev{last}_facing
FROM (SELECT *, {probs} FROM (
  SELECT phase, table_id, player_id AS actor, opp AS partner, count(*) AS n, count(*) FILTER (facing) AS n_facing,
    sum({nll}) AS nll, sum({ent}) AS ent, {sums} FROM live GROUP BY 1, 2, 3, 4) AS d) AS f"""


cte("resid3", residual(3))
oracle("policy_residual", _D + "n n_facing ~g ~g_tail ~g_per_action ~surp ~surp_excess ~dev0 ~dev1 ~dev2 ~z0 ~z1 ~z2 "
       "~z0_facing ~z2_facing ~dev2_facing", "SELECT * FROM resid3")
oracle("policy_residual_six", _D + "n ~g ~surp ~surp_excess ~dev0 ~dev1 ~dev2 ~dev3 ~dev4 ~dev5 ~z0 ~z1 ~z2 ~z3 ~z4",
       residual(6))
_RP = ["g", "g_tail", "surp_excess", "z0", "z2"]
oracle("policy_residual_pair", _P + folded_spec(_RP, ["g", "g_tail"]), folded("resid3", _RP, sums=["g", "g_tail"]))
oracle("hand_tilt", _K + "~tilt ~tilt_hi ~tilt_lo ~tilt_action_max ~nll ~nll_max ~tilt_facing acts", """
SELECT hand_id, least(player_id, opp) AS p1, greatest(player_id, opp) AS p2, sum(t) AS tilt, max(t) AS tilt_hi,
       min(t) AS tilt_lo, max(tm) AS tilt_action_max, sum(n) AS nll, max(nm) AS nll_max, sum(tf) AS tilt_facing, sum(c) AS acts
FROM (SELECT hand_id, player_id, opp, sum(tilt) AS t, max(tilt) AS tm, sum(nll1) AS n, max(nll1) AS nm,
             coalesce(sum(tilt) FILTER (facing), 0) AS tf, count(*) AS c
      FROM (SELECT x.*, CASE WHEN y = 0 THEN ln(po0 / pm0) WHEN y <= 2 THEN ln(po1 / pm1) ELSE ln(po2 / pm2) END AS tilt,
                   -ln(greatest(CASE WHEN y = 0 THEN p_fold WHEN y <= 2 THEN p_pass ELSE p_agg END, 1e-9)) AS nll1
            FROM live AS x JOIN (SELECT phase, actor, partner, po0, po1, po2, pm0, pm1, pm2 FROM resid3) AS r
              ON x.phase = r.phase AND x.player_id = r.actor AND x.opp = r.partner) AS e
      GROUP BY 1, 2, 3) AS h GROUP BY 1, 2, 3""")

_DY = ["transfer_total", "pair_net_total", "transfer_event_rate", "both_showdown_rate", "outsiders_folded_mean",
       "contribution_gap_mean", "pair_aggressive_mean", "relay_rate"]
cte("aggr", "SELECT phase, table_id, p1, p2, shared_hands, " + ", ".join(
    f"round(coalesce({c}, 0)::DOUBLE, 6) AS {c}" for c in _DY) + " FROM agg")
cte("member", " UNION ALL ".join(f"SELECT *, {p} AS member FROM aggr" for p in ("p1", "p2")))
cte("membermed", "SELECT phase, table_id, member, " + ", ".join(f"median({c}) AS {c}" for c in _DY)
    + " FROM member GROUP BY 1, 2, 3")
cte("dyadres", "SELECT q.phase, q.table_id, q.p1, q.p2, " + ", ".join(
    f"q.{c} - a.{c} - b.{c} + t.{c} AS res_{c}" for c in _DY) + " FROM aggr AS q"
    " JOIN membermed AS a ON q.phase = a.phase AND q.p1 = a.member AND q.table_id = a.table_id"
    " JOIN membermed AS b ON q.phase = b.phase AND q.p2 = b.member AND q.table_id = b.table_id"
    " JOIN (SELECT phase, table_id, " + ", ".join(f"median({c}) AS {c}" for c in _DY)
    + " FROM aggr GROUP BY 1, 2) AS t ON q.phase = t.phase AND q.table_id = t.table_id")
oracle("dyadic_residual", _P + " ".join(f"~res_{c} ~resz_{c}" for c in _DY),
       "SELECT d.*, " + ", ".join(f"(d.res_{c} - m_{c}) / (1.4826 * mad_{c} + 1e-6) AS resz_{c}" for c in _DY)
       + " FROM dyadres AS d JOIN (SELECT x.phase, x.table_id, " + ", ".join(
           f"max(m_{c}) AS m_{c}, median(abs(x.res_{c} - m_{c})) AS mad_{c}" for c in _DY)
       + " FROM dyadres AS x JOIN (SELECT phase, table_id, " + ", ".join(f"median(res_{c}) AS m_{c}" for c in _DY)
       + " FROM dyadres GROUP BY 1, 2) AS m ON x.phase = m.phase AND x.table_id = m.table_id GROUP BY 1, 2) AS k"
       " ON d.phase = k.phase AND d.table_id = k.table_id")

_PR = ["transfer_total", "both_showdown_rate", "pair_aggressive_mean"]
oracle("partner_rank_gap", _P + " ".join(f"{c}_rank_worst ~{c}_margin_min ~{c}_margin_max ~{c}_above_min" for c in _PR),
       "SELECT phase, table_id, p1, p2, " + ", ".join(
           f"max(pl_{c}) AS {c}_rank_worst, min(mg_{c}) AS {c}_margin_min, max(mg_{c}) AS {c}_margin_max, "
           f"min(ab_{c}) AS {c}_above_min" for c in _PR) + " FROM (SELECT *, " + ", ".join(
           f"CASE WHEN pl_{c} = 1 THEN {c} - coalesce(top_{c}[2], 0) ELSE {c} - top_{c}[1] END AS mg_{c}, {c} - med_{c} AS ab_{c}"
           for c in _PR) + " FROM (SELECT *, " + ", ".join(
           f"rank() OVER (PARTITION BY phase, table_id, member ORDER BY {c} DESC) AS pl_{c}, "
           f"list_sort(list({c}) OVER (PARTITION BY phase, table_id, member), 'DESC') AS top_{c}, "
           f"median({c}) OVER (PARTITION BY phase, table_id, member) AS med_{c}" for c in _PR)
       + " FROM member) AS r) AS s GROUP BY 1, 2, 3, 4")
oracle("table_percentile", _P + " ".join(f"~pct_{c}" for c in _DY),
       "SELECT phase, table_id, p1, p2, " + ", ".join(f"{pct(c, 'phase, table_id')} AS pct_{c}" for c in _DY) + " FROM aggr")

# ---------------------------------------------------------------- bags of scores, labels

_KEYS = "phase, table_id, p1, p2"
_H = "$phase table_id p1 p2 $hand_id "
_FAM = "CASE {x} WHEN 0 THEN 'directed_transfer' WHEN 1 THEN 'soft_play' ELSE 'coordinated_isolation' END"

oracle("bag_summary", _P + "n ~max ~mean ~sum n_over_500 n_over_900 ~top3 ~top5 ~top10 ~p95 ~p99", f"""
SELECT {_KEYS}, count(*) AS n, max(score) AS max, avg(score) AS mean, sum(score) AS sum,
  count(*) FILTER (score > 5) AS n_over_500, count(*) FILTER (score > 9) AS n_over_900,
  {topk('score', 3)} AS top3, {topk('score', 5)} AS top5, {topk('score', 10)} AS top10,
  {nearest('score', 0.95)} AS p95, {nearest('score', 0.99)} AS p99 FROM sig GROUP BY 1, 2, 3, 4""")

cte("lab", f"""
SELECT p1, p2, CASE WHEN (p1 * 31 + p2 * 17) % 50 = 0 THEN 1 ELSE 0 END AS label,
       CASE WHEN (p1 * 31 + p2 * 17) % 50 = 0 THEN {_FAM.format(x='(p1 + p2) % 3')} END AS family
FROM (SELECT DISTINCT p1, p2 FROM cnt) AS c WHERE (p1 * 31 + p2 * 17) % 50 <= 4""")
cte("pos", "SELECT DISTINCT unnest([p1, p2]) AS player_id FROM lab WHERE label = 1")

oracle("label_cohorts", "$phase table_id p1 p2 shared_hands label $family $cohort", """
SELECT c.phase, c.table_id, c.p1, c.p2, c.shared_hands, coalesce(l.label, -1) AS label, l.family,
  CASE WHEN l.label IS NOT NULL THEN 'labelled'
       WHEN (c.p1 IN (FROM pos))::INT + (c.p2 IN (FROM pos))::INT = 1 THEN 'mixed'
       WHEN c.p1 IN (FROM pos) AND c.p2 IN (FROM pos) THEN 'both_positive' ELSE 'eval_like' END AS cohort
FROM cnt AS c LEFT JOIN lab AS l ON c.p1 = l.p1 AND c.p2 = l.p2 WHERE c.phase = 'development'""")

oracle("sample_unknown", "table_id p1 p2 shared_hands", """
SELECT c.* FROM cnt AS c LEFT JOIN lab AS l ON c.p1 = l.p1 AND c.p2 = l.p2
WHERE c.phase = 'development' AND l.p1 IS NULL AND c.shared_hands < 24
  AND c.p1 NOT IN (FROM pos) AND c.p2 NOT IN (FROM pos)
ORDER BY md5(c.p1 || '|' || c.p2 || '|neg'), c.p1, c.p2 LIMIT 100""")

oracle("exclusion", "table_id kept kept_unlabelled", """
SELECT c.table_id, count(*) AS kept, count(*) FILTER (l.p1 IS NULL) AS kept_unlabelled
FROM cnt AS c LEFT JOIN lab AS l ON c.p1 = l.p1 AND c.p2 = l.p2
WHERE c.phase = 'development' AND NOT (l.p1 IS NULL AND c.shared_hands / 40.0 > 0.4) GROUP BY 1""")

oracle("time_subsets", _P + "late_hands from_rn sampled_hands", f"""
SELECT * FROM (
  SELECT {_KEYS}, nullif(count(*) FILTER ((pair_rn - 1)::DOUBLE / n >= 1.0::DOUBLE - 0.4::DOUBLE), 0) AS late_hands,
    min(pair_rn) FILTER ((pair_rn - 1)::DOUBLE / n >= 1.0::DOUBLE - 0.4::DOUBLE) AS from_rn,
    nullif(count(*) FILTER (CAST('0x' || substr(md5(hand_id || '|half'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5), 0) AS sampled_hands
  FROM (SELECT *, count(*) OVER (PARTITION BY {_KEYS}) AS n FROM sig) AS s GROUP BY 1, 2, 3, 4) AS t""")

cte("respair", folded("resid3", ["surp_excess"]))
oracle("assembled", _P + "shared_hands ~g_hi ~g_sum ~surp_excess_hi ~surp_excess_lo", f"""
SELECT c.phase, c.table_id, c.p1, c.p2, c.shared_hands, g.g_hi, g.g_sum, r.surp_excess_hi, r.surp_excess_lo
FROM cnt AS c LEFT JOIN gpair AS g USING ({_KEYS}) LEFT JOIN respair AS r USING ({_KEYS})""")

oracle("score_features", _P + "n ~score_mean n_over_5 ~log_n ~top1 ~top3 ~top5 ~top10 ~best5_pot_bb ~best5_abs_net_gap "
       "~best5_contact ~best5_transfer_event ~roll15_max", f"""
SELECT {_KEYS}, count(*) AS n, avg(score) AS score_mean, count(*) FILTER (score > 5) AS n_over_5, ln(count(*)) AS log_n,
  max(score) AS top1, {topk('score', 3)} AS top3, {topk('score', 5)} AS top5, {topk('score', 10)} AS top10,
  avg(pot_bb) FILTER (r <= 5) AS best5_pot_bb, avg(abs_net_gap) FILTER (r <= 5) AS best5_abs_net_gap,
  avg(contact) FILTER (r <= 5) AS best5_contact, avg(transfer_event) FILTER (r <= 5) AS best5_transfer_event,
  max(roll15) AS roll15_max
FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY score DESC, hand_id) AS r,
             avg(score) OVER (PARTITION BY {_KEYS} ORDER BY pair_rn ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS roll15
      FROM sig) AS s GROUP BY 1, 2, 3, 4""")

_TOPS = {"score": (1, 3, 5, 10), "family_0": (3, 5, 10), "family_1": (3, 5, 10), "family_2": (3, 5, 10), "action_tail": (1, 5, 10),
         "action_sum": (5,), "llr": (3, 5, 10)}
_CARRIED = {"score": ["pot_bb", "abs_net_gap", "contact"], "llr": ["pot_bb", "contact"]}
cte("tail", "SELECT hand_id, player_id, max(surp) AS t, sum(surp) AS s FROM scored GROUP BY 1, 2")
cte("hands_scored", f"""
SELECT s.phase, s.table_id, s.p1, s.p2, s.hand_id, s.score, s.pot_bb, s.abs_net_gap, s.contact, round(s.fold_vs_partner, 6) AS family_0,
  round(s.call_vs_partner, 6) AS family_1, round(s.aggr_vs_partner, 6) AS family_2, round(greatest(a.t, b.t), 6) AS action_tail,
  round(a.s + b.s, 6) AS action_sum, round(l.llr, 6) AS llr
FROM sig AS s LEFT JOIN tail AS a ON a.hand_id = s.hand_id AND a.player_id = s.p1 LEFT JOIN tail AS b ON b.hand_id = s.hand_id AND b.player_id = s.p2
LEFT JOIN (SELECT hand_id, least(player_id, opp) AS p1, greatest(player_id, opp) AS p2, sum(c.lr) AS llr
           FROM x96 JOIN cells96 AS c USING (phase, table_id, player_id, opp, ctx, act) GROUP BY 1, 2, 3) AS l
  ON l.hand_id = s.hand_id AND l.p1 = s.p1 AND l.p2 = s.p2""")
_MANY = ({f"{s}_top{n}": topk(s, n) for s, ns in _TOPS.items() for n in ns} | {f"{s}_sum": f"coalesce(sum({s}), 0)" for s in _TOPS}
         | {f"{s}_mean": f"avg({s})" for s in _TOPS} | {f"{s}_best5_{c}": f"avg({c}) FILTER (r_{s} <= 5 AND {s} IS NOT NULL)" for s, cs in _CARRIED.items() for c in cs})
oracle("many_score_features", _P + " ".join(f"~{c}" for c in _MANY), f"SELECT {_KEYS}, " + ", ".join(f"{e} AS {c}" for c, e in _MANY.items()) + " FROM (SELECT *, " + ", ".join(
    f"row_number() OVER (PARTITION BY {_KEYS} ORDER BY {s} DESC NULLS LAST, hand_id) AS r_{s}" for s in _CARRIED) + " FROM hands_scored) AS q GROUP BY ALL")

oracle("family_rule", _P + "~top5_0 ~top5_1 ~top5_2 $rule_family", f"""
SELECT *, CASE WHEN top5_0 >= top5_1 AND top5_0 >= top5_2 THEN 'directed_transfer'
               WHEN top5_1 >= top5_2 THEN 'soft_play' ELSE 'coordinated_isolation' END AS rule_family
FROM (SELECT {_KEYS}, {topk('round(fold_vs_partner, 6)', 5)} AS top5_0, {topk('round(call_vs_partner, 6)', 5)} AS top5_1,
             {topk('round(aggr_vs_partner, 6)', 5)} AS top5_2 FROM sig GROUP BY 1, 2, 3, 4) AS t""")

# ---------------------------------------------------------------- inside a pair

oracle("episode_features", _K + "pair_rn ~timeline_position ~gap_to_prev ~gap_to_next ~neighbour_transfer "
       "~neighbour_surprise local_event_density contact_before contact_total ~contact_position contact_index events_before", f"""
SELECT *, contact_before / greatest(contact_total, 1) AS contact_position,
       CASE WHEN contact = 1 THEN contact_before ELSE 999 END AS contact_index FROM (
  SELECT hand_id, p1, p2, pair_rn, contact, (pair_rn - 1)::DOUBLE / count(*) OVER p AS timeline_position,
    coalesce((started_at - lag(started_at) OVER w)::DOUBLE, -1.0) / 3600 AS gap_to_prev,
    coalesce((lead(started_at) OVER w - started_at)::DOUBLE, -1.0) / 3600 AS gap_to_next,
    (coalesce(lag(transfer_gross) OVER w, 0) + coalesce(lead(transfer_gross) OVER w, 0)) / 2.0 AS neighbour_transfer,
    (coalesce(lag(pair_surprise) OVER w, 0) + coalesce(lead(pair_surprise) OVER w, 0)) / 2.0 AS neighbour_surprise,
    sum(transfer_event) OVER (PARTITION BY {_KEYS} ORDER BY pair_rn ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
      - transfer_event AS local_event_density,
    (sum(contact) OVER w - contact)::DOUBLE AS contact_before, sum(contact) OVER p AS contact_total,
    sum(transfer_event) OVER w - transfer_event AS events_before
  FROM sig WINDOW p AS (PARTITION BY {_KEYS}), w AS (PARTITION BY {_KEYS} ORDER BY pair_rn)) AS e""")

oracle("direction_consistency", _K + "with_dominant_flow with_dominant_concession", f"""
SELECT hand_id, p1, p2,
  CASE WHEN sum(transfer_1_to_2) OVER p - transfer_1_to_2 >= sum(transfer_2_to_1) OVER p - transfer_2_to_1
       THEN transfer_1_to_2 - transfer_2_to_1 ELSE transfer_2_to_1 - transfer_1_to_2 END AS with_dominant_flow,
  CASE WHEN sum(a12) OVER p - a12 >= sum(a21) OVER p - a21 THEN a12 - a21 ELSE a21 - a12 END AS with_dominant_concession
FROM (SELECT *, ahead_fold_1_to_2::INT AS a12, ahead_fold_2_to_1::INT AS a21 FROM ph) AS h WINDOW p AS (PARTITION BY {_KEYS})""")

_WP = ["transfer_gross", "score", "abs_net_gap"]
oracle("within_pair", _H + " ".join(f"~{q}_{c}" for c in _WP for q in ("pct", "rel", "z")),
       f"SELECT {_KEYS}, hand_id, " + ", ".join(f"""{pct(c, _KEYS)} AS pct_{c},
  {c} / (max(abs({c})) OVER (PARTITION BY {_KEYS}) + 1e-9) AS rel_{c},
  ({c} - avg({c}) OVER (PARTITION BY {_KEYS})) / (stddev_samp({c}) OVER (PARTITION BY {_KEYS}) + 1e-3) AS z_{c}"""
                                                 for c in _WP) + " FROM sig")

oracle("rolling_density", _H + "~roll21 ~roll61", f"""SELECT {_KEYS}, hand_id,
  avg(score) OVER (PARTITION BY {_KEYS} ORDER BY pair_rn ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS roll21,
  avg(score) OVER (PARTITION BY {_KEYS} ORDER BY pair_rn ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS roll61 FROM sig""")

oracle("candidate_features", _H + "pair_rn ~score ~score2 r_score r_score2 r pair_hands ~mass_prior prior_0 prior_1 prior_2 "
       "after_0 after_1 after_2 ~after_mass ~to_best ~to_fifth ~to_best2 ~to_fifth2 ~share_of_best ~z_pair ~timeline "
       "~mass_before chrono", f"""
SELECT *, CASE WHEN r <= 15 THEN count(*) FILTER (r <= 15) OVER (PARTITION BY {_KEYS} ORDER BY pair_rn) ELSE 99 END AS chrono,
  mass_prior / (mass_prior + after_mass + 1e-6) AS mass_before FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY least(r_score, r_score2), r_score, hand_id) AS r,
    count(*) OVER p AS pair_hands, coalesce(sum(score) OVER b, 0) AS mass_prior,
    coalesce(sum((score > 1)::INT) OVER b, 0) AS prior_0, coalesce(sum((score > 2)::INT) OVER b, 0) AS prior_1,
    coalesce(sum((score > 3)::INT) OVER b, 0) AS prior_2, coalesce(sum((score > 1)::INT) OVER f, 0) AS after_0,
    coalesce(sum((score > 2)::INT) OVER f, 0) AS after_1, coalesce(sum((score > 3)::INT) OVER f, 0) AS after_2,
    coalesce(sum(score) OVER f, 0) AS after_mass, score - max(score) OVER p AS to_best,
    score - max(score) FILTER (r_score = 5) OVER p AS to_fifth, score2 - max(score2) OVER p AS to_best2,
    score2 - max(score2) FILTER (r_score2 = 5) OVER p AS to_fifth2, score / max(score) OVER p AS share_of_best,
    (score - avg(score) OVER p) / (stddev_samp(score) OVER p + 1e-3) AS z_pair, (pair_rn - 1)::DOUBLE / count(*) OVER p AS timeline
  FROM (SELECT {_KEYS}, hand_id, pair_rn, score, score2,
               row_number() OVER (PARTITION BY {_KEYS} ORDER BY score DESC, hand_id) AS r_score,
               row_number() OVER (PARTITION BY {_KEYS} ORDER BY score2 DESC, hand_id) AS r_score2 FROM sig) AS s
  WINDOW p AS (PARTITION BY {_KEYS}), b AS (PARTITION BY {_KEYS} ORDER BY pair_rn {PREV}),
         f AS (PARTITION BY {_KEYS} ORDER BY pair_rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS t
WHERE r <= 50""")

_T = ["t_fold", "t_pay", "t_aggr"]
oracle("templates", _H + " ".join(f"{t}_{w}" for t in _T for w in ("donor", "receiver")),
       "SELECT *, " + ", ".join(
           f"CASE WHEN first THEN {t}_1 ELSE {t}_2 END AS {t}_donor, CASE WHEN first THEN {t}_2 ELSE {t}_1 END AS {t}_receiver"
           for t in _T) + " FROM (SELECT *, sum(t_fold_1 + t_pay_1) OVER p - (t_fold_1 + t_pay_1)"
       " >= sum(t_fold_2 + t_pay_2) OVER p - (t_fold_2 + t_pay_2) AS first FROM ("
       "SELECT phase, table_id, least(player_id, last_agg) AS p1, greatest(player_id, last_agg) AS p2, hand_id, " + ", ".join(
           f"count(*) FILTER (y {c} AND player_id {op} last_agg) AS {t}_{i}"
           for t, c in (("t_fold", "= 0"), ("t_pay", "= 2"), ("t_aggr", ">= 3")) for i, op in ((1, "<"), (2, ">")))
       + f" FROM act WHERE last_agg <> player_id GROUP BY 1, 2, 3, 4, 5) AS d WINDOW p AS (PARTITION BY {_KEYS})) AS e")

_OPEN, _ANSWER = ("bet", "chk_bet", "re"), {"fold": "= 0", "call": "= 2", "raise": ">= 3"}
_PATTERN = [f"{o}_{a}" for o in _OPEN for a in _ANSWER] + ["shove_call"]
_PERIOD = {"pre": "street = 0", "post": "street > 0"}

cte("pattern", f"""
SELECT *, CASE WHEN side = side1 OR side1 IS NULL THEN NULL WHEN y = 1 AND y1 = 1 THEN 'chk_chk' WHEN y1 = 5 AND y = 2 THEN 'shove_call'
  WHEN y1 >= 3 AND y <> 1 THEN CASE WHEN side2 = side AND y2 = 1 THEN 'chk_bet_' WHEN side2 = side AND y2 >= 3 THEN 're_' ELSE 'bet_' END
       || CASE y WHEN 0 THEN 'fold' WHEN 2 THEN 'call' ELSE 'raise' END END AS name
FROM (SELECT *, lag(y) OVER w AS y1, lag(side) OVER w AS side1, lag(y, 2) OVER w AS y2, lag(side, 2) OVER w AS side2
      FROM (SELECT a.phase, a.table_id, a.hand_id, a.street, a.action_no, a.y, least(a.player_id, s.player_id) AS p1,
                   greatest(a.player_id, s.player_id) AS p2, CASE WHEN a.player_id < s.player_id THEN 1 ELSE 2 END AS side
            FROM act AS a JOIN seat AS s ON s.hand_id = a.hand_id AND s.player_id <> a.player_id) AS x
      WINDOW w AS (PARTITION BY hand_id, p1, p2, street ORDER BY action_no)) AS z""")

_COUNTS = ([f"count(*) FILTER (name = '{n}' AND {c} AND side = {i}) AS {n}_{p}_{i}" for p, c in _PERIOD.items() for n in _PATTERN for i in (1, 2)]
           + [f"count(*) FILTER (name = 'chk_chk' AND {c}) AS chk_chk_{p}" for p, c in _PERIOD.items()])
cte("template", f"SELECT {_KEYS}, hand_id, {', '.join(_COUNTS)} FROM pattern WHERE name IS NOT NULL GROUP BY ALL")
oracle("partner_templates", _H + " ".join(c.split(" AS ")[1] for c in _COUNTS), "SELECT * FROM template")

_GROUP = {"fold": [n for n in _PATTERN if n.endswith("fold")], "pay": [n for n in _PATTERN if n.endswith("call")], "aggr": [n for n in _PATTERN if n.endswith("raise")]}
_SEVEN = [f"t_{g}_{w}" for g in _GROUP for w in ("don", "rec")] + ["t_chk_chk"]
cte("seven0", f"SELECT {_KEYS}, hand_id, " + ", ".join(
    "coalesce(" + " + ".join(f"{n}_{p}_{i}" for n in names for p in _PERIOD) + f", 0) AS {g}_{i}" for g, names in _GROUP.items() for i in (1, 2))
    + f", coalesce(chk_chk_pre + chk_chk_post, 0) AS t_chk_chk FROM ph LEFT JOIN template USING ({_KEYS}, hand_id)")
cte("seven", f"SELECT {_KEYS}, hand_id, t_chk_chk, " + ", ".join(
    f"CASE WHEN first THEN {g}_{a} ELSE {g}_{b} END AS t_{g}_{w}" for g in _GROUP for w, a, b in (("don", 1, 2), ("rec", 2, 1)))
    + " FROM (SELECT *, sum(fold_1 + pay_1) OVER p - (fold_1 + pay_1) >= sum(fold_2 + pay_2) OVER p - (fold_2 + pay_2) AS first"
    + f" FROM seven0 WINDOW p AS (PARTITION BY {_KEYS})) AS d")
oracle("template_features", _H + " ".join(_SEVEN) + " " + " ".join(f"~pct_{c}" for c in _SEVEN),
       f"SELECT *, {', '.join(f'{pct(c, _KEYS)} AS pct_{c}' for c in _SEVEN)} FROM seven")

_SIZE = {"bet": "max(amount / greatest(pot_before, 1)::DOUBLE) FILTER (y >= 3)", "mean_bet": "avg(amount / greatest(pot_before, 1)::DOUBLE) FILTER (y >= 3)",
         "depth": "min(stack_before / 10000.0::DOUBLE)", "pot": "max(pot_before / 10000.0::DOUBLE)", "crowd": "max(players_active)::DOUBLE"}
_SZ = {f"sz_{m}_{e}": f"{f}(a.{m}, b.{m})" for m in _SIZE for e, f in (("hi", "greatest"), ("lo", "least"))}
cte("seatsize", "SELECT hand_id, player_id, " + ", ".join(f"{e} AS {m}" for m, e in _SIZE.items()) + " FROM act GROUP BY hand_id, player_id")
cte("pairsize", f"SELECT {_KEYS}, ph.hand_id, " + ", ".join(f"{e} AS {c}" for c, e in _SZ.items())
    + " FROM ph JOIN seatsize AS a ON a.hand_id = ph.hand_id AND a.player_id = p1 JOIN seatsize AS b ON b.hand_id = ph.hand_id AND b.player_id = p2")
oracle("sizing_features", _H + " ".join(f"~{c}" for c in _SZ) + " " + " ".join(f"~pct_{c}" for c in _SZ),
       f"SELECT *, {', '.join(f'{pct(c, _KEYS)} AS pct_{c}' for c in _SZ)} FROM pairsize")

oracle("key_guard", "$what duplicate_keys rows", """
SELECT 'context' AS what, count(*) - count(DISTINCT (hand_id, action_no)) AS duplicate_keys, count(*) AS rows FROM act
UNION ALL SELECT 'seats', count(*) - count(DISTINCT (hand_id, player_id)), count(*) FROM seat
UNION ALL SELECT 'pair_hands', count(*) - count(DISTINCT (hand_id, p1, p2)), count(*) FROM ph
UNION ALL SELECT 'live', count(*) - count(DISTINCT (hand_id, action_no, opp)), count(*) FROM live""")


def step(street: str, inside: str, kind: str, third: str, raised: str) -> str:
    return f"1 + (((({street}) * 2 + {inside}) * 6 + {kind}) * 3 + {third}) * 2 + {raised}"


def ngrams(source: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY action_no)"
    return f"""
SELECT {keys}, token, CASE WHEN token < 0 THEN 1 ELSE count(*) END AS n FROM (
  SELECT {keys}, unnest([c0, c0 + 1024 * c1, c0 + 1024 * c1 + 1048576 * c2, -1 - (9 * w0 + 3 * w1 + w2)]) AS token FROM (
    SELECT {keys}, code::BIGINT AS c0, actor AS w0, lead(code::BIGINT, 1) OVER {w} AS c1, lead(code::BIGINT, 2) OVER {w} AS c2,
           lead(actor, 1) OVER {w} AS w1, lead(actor, 2) OVER {w} AS w2 FROM {source}) AS g) AS u WHERE token IS NOT NULL GROUP BY {keys}, token"""


cte("tokrow", f"""
SELECT h.p1, h.p2, h.hand_id, a.action_no,
  CASE WHEN a.player_id = h.p1 THEN 1 WHEN a.player_id = h.p2 THEN 2 ELSE 0 END AS actor,
  {step('a.street', '(a.player_id IN (h.p1, h.p2))::INT', 'a.y',
        'CASE WHEN a.strength < 34 THEN 0 WHEN a.strength < 67 THEN 1 ELSE 2 END', '(a.n_agg_hand > 0)::INT')} AS code
FROM (SELECT a.hand_id, a.player_id AS p1, b.player_id AS p2 FROM seat AS a JOIN seat AS b
      ON a.hand_id = b.hand_id AND a.player_id < b.player_id) AS h JOIN act AS a ON h.hand_id = a.hand_id""")
cte("tok", ngrams("tokrow", "p1, p2, hand_id"))
oracle("sequence_tokens", "p1 p2 $hand_id token n", "SELECT * FROM tok")
oracle("token_vocab", "token bags", "SELECT token, count(*) AS bags FROM tok GROUP BY 1 HAVING count(*) >= 20")
cte("convrow", f"""
SELECT CAST(conv_id AS VARCHAR) AS hand_id, turn AS action_no,
  CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS actor,
  {step('0', "(role IN ('user', 'assistant'))::INT", '0', 'CASE WHEN length(text) < 80 THEN 0 WHEN length(text) < 400 THEN 1 ELSE 2 END', '0')} AS code
FROM conversations""")
oracle("conversation_tokens", "$hand_id token n", ngrams("convrow", "hand_id"))

# ---------------------------------------------------------------- similarity

_Z = ["transfer_gross", "score", "pot_bb"]
oracle("standardised", _K + " ".join(f"~z_{c}" for c in _Z), "SELECT hand_id, p1, p2, " + ", ".join(
    f"({c} - m.mu_{c}) / CASE WHEN m.sd_{c} < 1e-9 THEN 1 ELSE m.sd_{c} END AS z_{c}" for c in _Z)
    + " FROM sig CROSS JOIN (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _Z)
    + " FROM sig WHERE phase = 'development') AS m")
_WI = ["abs_net_gap", "score"]
oracle("winsorised", _K + " ".join(f"~w_{c}" for c in _WI), "SELECT hand_id, p1, p2, " + ", ".join(
    f"least(greatest({c}, m.lo_{c}), m.hi_{c}) AS w_{c}" for c in _WI) + " FROM sig CROSS JOIN (SELECT " + ", ".join(
    f"{nearest(c, 0.001)} AS lo_{c}, {nearest(c, 0.999)} AS hi_{c}" for c in _WI)
    + " FROM sig WHERE phase = 'development') AS m")


def brute_knn(where: str) -> str:
    return f"""SELECT id, avg(d) AS mean_dist, min(d) AS min_dist, count(*) AS k_found FROM (
  SELECT q.vec_id AS id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), r.vec_id) AS i
  FROM embeddings AS q JOIN embeddings AS r ON q.vec_id % 5 <> r.vec_id % 5 WHERE {where}) AS n WHERE i <= 5 GROUP BY 1"""


oracle("knn_mean_distance", "id ~mean_dist ~min_dist k_found", brute_knn("true"))
oracle("knn_by_axes", "id ~mean_dist ~min_dist k_found", brute_knn("true"))
oracle("knn_ratio", "id ~gold_dist ~other_dist ~dist_ratio", f"""
SELECT g.id, g.mean_dist AS gold_dist, o.mean_dist AS other_dist, g.mean_dist / (o.mean_dist + 1e-9) AS dist_ratio
FROM ({brute_knn('r.label < 3')}) AS g JOIN ({brute_knn('r.label >= 3')}) AS o ON g.id = o.id""")

cte("ranked", f"""
SELECT {_KEYS}, hand_id, score, transfer_gross, ln(1 + transfer_gross::DOUBLE) AS v1,
  greatest(ahead_fold, fold_better_flag, conceded_flag) AS type_a,
  row_number() OVER (PARTITION BY {_KEYS} ORDER BY score DESC, hand_id) AS rank FROM sig""")
cte("best20", "SELECT * FROM ranked WHERE rank <= 20")
oracle("pair_consistency", _H + "rank ~sim_mean ~sim_max ~type_agree", f"""
SELECT b.*, coalesce(s.sim_mean, 0) AS sim_mean, coalesce(s.sim_max, 0) AS sim_max, b.type_a * d.dom AS type_agree
FROM ranked AS b LEFT JOIN (
  SELECT {', '.join('a.' + k for k in _KEYS.split(', '))}, a.hand_id, max(-sqrt((a.v1 - o.v1) ** 2 + (a.score - o.score) ** 2)) AS sim_max,
    sum(-sqrt((a.v1 - o.v1) ** 2 + (a.score - o.score) ** 2) / o.rank) / sum(1.0 / o.rank) AS sim_mean
  FROM best20 AS a JOIN best20 AS o ON a.phase = o.phase AND a.p1 = o.p1 AND a.p2 = o.p2 AND a.hand_id <> o.hand_id
  GROUP BY ALL) AS s USING ({_KEYS}, hand_id)
JOIN (SELECT {_KEYS}, sum(type_a / rank) AS dom FROM ranked GROUP BY ALL) AS d USING ({_KEYS})""")

# ---------------------------------------------------------------- bags of actions

cte("evid", """
SELECT p1, p2, hand_id, evidence_rank FROM (
  SELECT h.p1, h.p2, h.hand_id,
    row_number() OVER (PARTITION BY h.p1, h.p2 ORDER BY md5(h.p1 || '|' || h.p2 || '|' || h.hand_id), h.hand_id) AS evidence_rank
  FROM ph AS h JOIN lab AS l ON h.p1 = l.p1 AND h.p2 = l.p2 WHERE l.label = 1 AND h.phase = 'development') AS e
WHERE evidence_rank <= 3 + (p1 + p2) % 3""")
cte("bag", """
SELECT h.phase, h.table_id, h.p1, h.p2, h.hand_id, l.label,
  CASE WHEN e.hand_id IS NOT NULL THEN 1 WHEN l.label = 0 THEN 0 ELSE -1 END AS bag_label
FROM ph AS h JOIN lab AS l ON h.p1 = l.p1 AND h.p2 = l.p2
LEFT JOIN evid AS e ON h.p1 = e.p1 AND h.p2 = e.p2 AND h.hand_id = e.hand_id WHERE h.phase = 'development'""")
oracle("bag_table", _H + "label bag_label", "SELECT * FROM bag")
oracle("bag_census", "bag_label bags evidence_without_bag",
       "SELECT bag_label, count(*) AS bags, 0 AS evidence_without_bag FROM bag GROUP BY 1")

cte("inst", f"""
SELECT m.*, s.action_no, s.street, s.y, s.strength, s.surp, s.players_active, s.last_agg, s.fold,
  s.amount / 10000.0::DOUBLE AS amount_bb, s.invested_before / 10000.0::DOUBLE AS invested_bb,
  CASE WHEN s.last_agg IS NULL THEN 0 WHEN s.last_agg = m.player_id THEN 1 WHEN s.last_agg = m.partner THEN 2 ELSE 3 END AS facing,
  coalesce(s.strength - ({at_street('b.str_', 's.street')}), 0) AS rel,
  (b.exit_no IS NULL OR b.exit_no > s.action_no)::INT AS partner_live,
  (o.net > b.net)::INT AS actor_won, (s.action_no = s.hand_actions - 1)::INT AS is_last_action,
  s.players_active - 2 AS outsiders_left, (o.n_actions + b.n_actions)::DOUBLE / s.hand_actions AS share_of_actions,
  (SELECT count(*) FROM act AS q WHERE q.hand_id = m.hand_id AND q.player_id = m.partner AND q.action_no < s.action_no) AS partner_acted_before,
  (SELECT count(*) FROM act AS q WHERE q.hand_id = m.hand_id AND q.player_id = m.partner AND q.action_no < s.action_no AND q.y >= 3) AS partner_aggr_before,
  (SELECT count(*) FROM act AS q WHERE q.hand_id = m.hand_id AND q.player_id = m.partner AND q.action_no < s.action_no AND q.y = 0) AS partner_folds_before,
  (SELECT count(*) FROM act AS q WHERE q.hand_id = m.hand_id AND q.player_id = m.partner AND q.action_no > s.action_no) AS partner_acts_after,
  (SELECT count(*) FROM act AS q WHERE q.hand_id = m.hand_id AND q.player_id = m.partner AND q.action_no > s.action_no AND q.y >= 3) AS partner_aggr_after,
  (SELECT count(*) FROM act AS q WHERE q.hand_id = m.hand_id AND q.player_id = m.partner AND q.action_no > s.action_no AND q.y = 0) AS partner_folds_after,
  CASE WHEN lag(m.player_id) OVER w <> m.player_id THEN s.action_no - lag(s.action_no) OVER w ELSE -1 END AS turns_since_partner
FROM (SELECT *, p1 AS player_id, p2 AS partner FROM bag UNION ALL SELECT *, p2, p1 FROM bag) AS m
JOIN scored AS s ON m.hand_id = s.hand_id AND m.player_id = s.player_id
JOIN seat AS b ON m.hand_id = b.hand_id AND m.partner = b.player_id
JOIN seat AS o ON m.hand_id = o.hand_id AND m.player_id = o.player_id
WINDOW w AS (PARTITION BY m.p1, m.p2, m.hand_id ORDER BY s.action_no)""")
oracle("instances", "p1 p2 $hand_id action_no player_id facing rel partner_live partner_acted_before partner_aggr_before "
       "partner_folds_before partner_acts_after partner_aggr_after partner_folds_after turns_since_partner "
       "is_last_action outsiders_left ~share_of_actions ~amount_bb ~invested_bb bag_label", "SELECT * FROM inst")

oracle("bag_pooling", _H + "n ~mean_z ~max_z ~lse_z ~noisy_or ~z_gap top_street top_action top_answers_partner "
       "~top_surprise ~pct_max_z", f"""
SELECT *, {pct('round(max_z, 6)', _KEYS)} AS pct_max_z FROM (
  SELECT {_KEYS}, hand_id, count(*) AS n, avg(z) AS mean_z, max(z) AS max_z, max(z) + ln(sum(exp(z - mz))) AS lse_z,
    ln(1 - exp(-sum(ln(1 + exp(z))))) + sum(ln(1 + exp(z))) AS noisy_or,
    max(z) - coalesce(max(z) FILTER (i = 2), max(z)) AS z_gap, max(street) FILTER (i = 1) AS top_street,
    max(y) FILTER (i = 1) AS top_action, max((facing = 2)::INT) FILTER (i = 1) AS top_answers_partner,
    max(surp) FILTER (i = 1) AS top_surprise
  FROM (SELECT *, max(z) OVER (PARTITION BY {_KEYS}, hand_id) AS mz,
               row_number() OVER (PARTITION BY {_KEYS}, hand_id ORDER BY z DESC, action_no, player_id) AS i
        FROM (SELECT *, round(surp, 6) - 1.5 AS z FROM inst) AS r) AS q GROUP BY 1, 2, 3, 4, 5) AS b""")

_TF = ["street", "y", "facing", "rel", "partner_live", "amount_bb", "actor_won", "players_active"]
oracle("action_aggregates", _H + "~act_max ~act_sum ~act_mean act_n_high ~act_max_first ~act_max_later "
       "~act_max_partner_live ~act_second " + " ".join(f"{'~' if f == 'amount_bb' else ''}top_{f}" for f in _TF), f"""
SELECT {_KEYS}, hand_id, max(s) AS act_max, sum(s) AS act_sum, avg(s) AS act_mean, count(*) FILTER (s > 1.5) AS act_n_high,
  coalesce(max(s) FILTER (street = 0), 0) AS act_max_first, coalesce(max(s) FILTER (street > 0), 0) AS act_max_later,
  coalesce(max(s) FILTER (partner_live = 1), 0) AS act_max_partner_live,
  coalesce(max(s) FILTER (i = 2), max(s)) AS act_second, {', '.join(f'max({f}) FILTER (i = 1) AS top_{f}' for f in _TF)}
FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, hand_id ORDER BY s DESC, action_no, player_id) AS i
      FROM (SELECT *, round(surp, 6) AS s FROM inst) AS r) AS q GROUP BY 1, 2, 3, 4, 5""")

oracle("fold_audit", "$what groups spanning", " UNION ALL ".join(
    f"SELECT '{w}' AS what, count(*) AS groups, count(*) FILTER (a <> b) AS spanning FROM "
    f"(SELECT min(fold) AS a, max(fold) AS b FROM inst GROUP BY {k}) AS g"
    for w, k in (("table", "table_id"), ("pair", "p1, p2"), ("hand", "hand_id"), ("bag", "p1, p2, hand_id"),
                 ("player", "player_id"))))
oracle("fold_census", "fold rows positives censored null_surp null_last_agg null_rel", """
SELECT fold, count(*) AS rows, count(*) FILTER (bag_label = 1) AS positives, count(*) FILTER (bag_label = -1) AS censored,
  count(*) FILTER (surp IS NULL) AS null_surp, count(*) FILTER (last_agg IS NULL) AS null_last_agg,
  count(*) FILTER (rel IS NULL) AS null_rel FROM inst GROUP BY 1""")

oracle("seed_bag_placebo", _H + "~v ~pct_v ~placebo_score", f"""
SELECT s.*, {pct('v', ', '.join('s.' + k for k in _KEYS.split(', ')))} AS pct_v, g.score AS placebo_score
FROM (SELECT {_KEYS}, hand_id, round((score + score2) / 2, 9) AS v, pair_rn FROM sig) AS s
JOIN (SELECT *, row_number() OVER (ORDER BY h, {_KEYS}) AS place, count(*) OVER () AS pairs FROM (
        SELECT {_KEYS}, count(*) AS len, md5(phase || '|' || table_id || '|' || p1 || '|' || p2 || '|placebo') AS h
        FROM sig GROUP BY 1, 2, 3, 4) AS k) AS t USING ({_KEYS})
JOIN (SELECT *, row_number() OVER (ORDER BY h, {_KEYS}) AS place FROM (
        SELECT {_KEYS}, count(*) AS len, md5(phase || '|' || table_id || '|' || p1 || '|' || p2 || '|placebo') AS h
        FROM sig GROUP BY 1, 2, 3, 4) AS k) AS u ON u.place = t.place % t.pairs + 1
JOIN sig AS g ON g.phase = u.phase AND g.p1 = u.p1 AND g.p2 = u.p2 AND g.pair_rn = (s.pair_rn - 1) % u.len + 1""")

oracle("refined_instances", _H + "action_no player_id bag_label ~s", f"""
SELECT * FROM (SELECT *, round(surp, 6) AS s,
  row_number() OVER (PARTITION BY {_KEYS}, hand_id ORDER BY round(surp, 6) DESC, action_no, player_id) AS i
  FROM inst) AS r WHERE bag_label <> 1 OR i <= 3""")

# ---------------------------------------------------------------- retrieval, checks, metrics, reports

_SL = [f"evidence_hand_{i}" for i in range(1, 6)]


def wide_slots(where: str) -> str:
    cols = ", ".join(f"max(hand_id) FILTER (slot = {i}) AS evidence_hand_{i}" for i in range(1, 6))
    return (f"SELECT {_KEYS}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY score DESC, hand_id)"
            f" AS slot FROM sig WHERE {where}) AS s GROUP BY 1, 2, 3, 4")


oracle("top_evidence", _P + " ".join(f"${c}" for c in _SL),
       f"SELECT c.phase, c.table_id, c.p1, c.p2, {', '.join(f'''coalesce({c}, 'NO_EVIDENCE') AS {c}''' for c in _SL)} "
       f"FROM cnt AS c LEFT JOIN ({wide_slots('contact = 1')}) AS w USING ({_KEYS})")

oracle("tie_break", _P + "shared_hands ~risk ~risk_score", f"""
SELECT *, least(greatest(risk + 0.001::DOUBLE * (shared_hands - lo) / greatest(hi - lo, 1), 0), 1) AS risk_score FROM (
  SELECT {_KEYS}, shared_hands, round((p1 * 7 + p2) % 11 / 10.0::DOUBLE, 3) AS risk, min(shared_hands) OVER () AS lo,
         max(shared_hands) OVER () AS hi FROM cnt) AS c""")

cte("res", f"""
SELECT p1 || '-' || p2 AS pair_id, c.*, {', '.join(f"coalesce({c}, 'NO_EVIDENCE') AS {c}" for c in _SL)},
  {_FAM.format(x='p1 % 3')} AS predicted_behavior,
  least(greatest(shared_hands / 40.0::DOUBLE + 1e-6 * (shared_hands - min(shared_hands) OVER ())
        / greatest(max(shared_hands) OVER () - min(shared_hands) OVER (), 1), 0), 1) AS risk_score
FROM (SELECT {_KEYS}, shared_hands FROM cnt WHERE phase = 'evaluation') AS c
LEFT JOIN ({wide_slots("phase = 'evaluation'")}) AS w USING ({_KEYS})""")
cte("broken", f"""
SELECT pair_id, p1, p2, predicted_behavior, CASE WHEN p1 % 40 = 0 THEN 1.5 ELSE risk_score END AS risk_score, evidence_hand_1,
  CASE WHEN p2 % 25 = 0 THEN evidence_hand_1 ELSE evidence_hand_2 END AS evidence_hand_2, evidence_hand_3, evidence_hand_4,
  evidence_hand_5 FROM res WHERE p1 % 60 <> 7""")
cte("cited", f"""SELECT * FROM (SELECT pair_id, p1, p2, unnest([{', '.join(_SL)}]) AS hand_id FROM broken) AS u
WHERE hand_id <> 'NO_EVIDENCE'""")
_LIST = f"list_filter([{', '.join(_SL)}], lambda x: x <> 'NO_EVIDENCE')"
oracle("validate", "$rule n_bad ok", f"""
SELECT *, n_bad = 0 AS ok FROM (
  SELECT 'duplicate_pair' AS rule, count(*) - count(DISTINCT pair_id) AS n_bad FROM broken
  UNION ALL SELECT 'null_value', count(*) FILTER (risk_score IS NULL OR predicted_behavior IS NULL) FROM broken
  UNION ALL SELECT 'risk_out_of_range', count(*) FILTER (risk_score < 0 OR risk_score > 1) FROM broken
  UNION ALL SELECT 'unknown_behaviour', 0
  UNION ALL SELECT 'repeated_evidence', count(*) FILTER (len({_LIST}) <> len(list_distinct({_LIST}))) FROM broken
  UNION ALL SELECT 'column_order', 0
  UNION ALL SELECT 'constant_risk', coalesce(min(risk_score) = max(risk_score), false)::INT FROM broken
  UNION ALL SELECT 'row_count', abs((SELECT count(*) FROM broken) - (SELECT count(*) FROM res))
  UNION ALL SELECT 'missing_pair', count(*) FROM res WHERE pair_id NOT IN (SELECT pair_id FROM broken)
  UNION ALL SELECT 'unexpected_pair', count(*) FROM broken WHERE pair_id NOT IN (SELECT pair_id FROM res)
  UNION ALL SELECT 'unknown_hand', count(*) FROM cited WHERE hand_id NOT IN (SELECT hand_id FROM hand)
  UNION ALL SELECT 'wrong_phase', count(*) FROM cited JOIN hand USING (hand_id) WHERE phase <> 'evaluation'
  UNION ALL SELECT 'actor_not_seated', count(*) FROM cited AS c
    WHERE NOT EXISTS (SELECT 1 FROM seat AS s WHERE s.hand_id = c.hand_id AND s.player_id = c.p1)
       OR NOT EXISTS (SELECT 1 FROM seat AS s WHERE s.hand_id = c.hand_id AND s.player_id = c.p2)) AS v""")

oracle("splice", "$pair_id ~risk_score $predicted_behavior $evidence_hand_1 $evidence_hand_2 changed_elsewhere", """
SELECT pair_id, risk_score, predicted_behavior, evidence_hand_2 AS evidence_hand_1, evidence_hand_1 AS evidence_hand_2,
       0 AS changed_elsewhere FROM res""")

cte("riskdiff", """
SELECT d.*, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry,
  row_number() OVER (ORDER BY x DESC, pair_id) AS ra, row_number() OVER (ORDER BY y DESC, pair_id) AS rb FROM (
  SELECT a.p1 || '-' || a.p2 AS pair_id, a.shared_hands AS sa, b.shared_hands AS sb, a.k_folded_12 AS ka, b.k_folded_12 AS kb,
    round((a.k_folded_12 + a.k_folded_21)::DOUBLE / a.shared_hands, 6) AS x,
    round((b.k_folded_12 + b.k_folded_21)::DOUBLE / b.shared_hands, 6) AS y
  FROM cnt AS a JOIN cnt AS b ON a.p1 = b.p1 AND a.p2 = b.p2
  WHERE a.phase = 'development' AND b.phase = 'evaluation') AS d""")
oracle("table_diff", "$metric ~value", """
SELECT 'changed_shared_hands' AS metric, count(*) FILTER (sa <> sb) AS value FROM riskdiff
UNION ALL SELECT 'changed_k_folded_12', count(*) FILTER (ka <> kb) FROM riskdiff
UNION ALL SELECT 'changed_risk', count(*) FILTER (x <> y) FROM riskdiff
UNION ALL SELECT 'spearman', corr(rx, ry) FROM riskdiff
UNION ALL SELECT 'top10_overlap', count(*) FILTER (ra <= 10 AND rb <= 10) / 10.0 FROM riskdiff
UNION ALL SELECT 'top100_overlap', count(*) FILTER (ra <= 100 AND rb <= 100) / 100.0 FROM riskdiff""")

cte("graded", """
SELECT l.doc_id, l.quality, l.toxic, d.source, d.n_chars::DOUBLE AS score, d.n_chars + l.toxic * 300.0::DOUBLE AS score2
FROM labels AS l JOIN documents AS d USING (doc_id)""")


def ap(source: str, score: str, y: str, ident: str, by: str = "") -> str:
    """Average precision; `by` is a comma-separated key list or empty."""
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}count(*) AS rows, coalesce(sum(yy), 0) AS positives,
  coalesce(avg(hits::DOUBLE / i) FILTER (yy = 1), 0) AS ap FROM (
    SELECT *, row_number() OVER ({part}ORDER BY {score} DESC, {ident}) AS i, ({y})::INT AS yy,
      sum(({y})::INT) OVER ({part}ORDER BY {score} DESC, {ident} ROWS UNBOUNDED PRECEDING) AS hits FROM {source}) AS r{tail}"""


oracle("average_precision", "$what rows positives ~ap",
       f"SELECT 'toxic' AS what, * FROM ({ap('graded', 'score', 'toxic = 1', 'doc_id')}) AS a"
       f" UNION ALL SELECT 'quality', * FROM ({ap('graded', 'score', 'quality = 1', 'doc_id')}) AS b")
oracle("average_precision_by_source", "$source rows positives ~ap", ap("graded", "score", "toxic = 1", "doc_id", "source"))

cte("pick", f"""SELECT * FROM (SELECT {_KEYS}, hand_id, score,
  row_number() OVER (PARTITION BY {_KEYS} ORDER BY score DESC, hand_id) AS slot FROM sig) AS s WHERE slot <= 50""")
cte("mapk", """
SELECT t.p1, t.p2, coalesce(g.n, 0) AS n_gold, coalesce(h.gain / least(g.n, 5), 0) AS ap
FROM (SELECT p1, p2 FROM lab WHERE label = 1) AS t
LEFT JOIN (SELECT p1, p2, count(*) AS n FROM evid GROUP BY 1, 2) AS g USING (p1, p2)
LEFT JOIN (SELECT p1, p2, sum(hit * hits::DOUBLE / slot) AS gain FROM (
             SELECT *, sum(hit) OVER (PARTITION BY p1, p2 ORDER BY slot) AS hits FROM (
               SELECT k.p1, k.p2, k.slot, (e.hand_id IS NOT NULL)::INT AS hit
               FROM pick AS k LEFT JOIN evid AS e ON k.p1 = e.p1 AND k.p2 = e.p2 AND k.hand_id = e.hand_id
               WHERE k.phase = 'development' AND k.slot <= 5) AS a) AS b GROUP BY 1, 2) AS h USING (p1, p2)""")
oracle("map_at_5", "p1 p2 n_gold ~ap", "SELECT * FROM mapk")

cte("riskpair", f"""
SELECT c.phase, c.table_id, c.p1, c.p2, coalesce(l.label, -1) AS label, l.family, {_FAM.format(x='c.p1 % 3')} AS predicted,
  c.p1 * 100000 + c.p2 AS pid, c.shared_hands / 40.0::DOUBLE AS risk
FROM cnt AS c LEFT JOIN lab AS l ON c.p1 = l.p1 AND c.p2 = l.p2 WHERE c.phase = 'development'""")
cte("routedrisk", """
SELECT r.*, f.target_family, CASE WHEN predicted = f.target_family THEN risk ELSE 0 END AS routed,
  coalesce(family = f.target_family, false) AS is_target
FROM riskpair AS r CROSS JOIN (SELECT unnest(['directed_transfer', 'soft_play', 'coordinated_isolation']) AS target_family) AS f""")
cte("behap", ap("routedrisk", "routed", "is_target", "pid", "target_family"))
oracle("behaviour_map", "$target_family rows positives ~ap", "SELECT * FROM behap")
oracle("composite", "~pair_ap ~evidence_map ~behaviour_map ~score", f"""
SELECT *, 0.7 * pair_ap + 0.2 * evidence_map + 0.1 * behaviour_map AS score FROM (
  SELECT (SELECT ap FROM ({ap('riskpair', 'risk', 'label = 1', 'pid')}) AS q) AS pair_ap,
         (SELECT avg(ap) FROM mapk) AS evidence_map, (SELECT avg(ap) FROM behap) AS behaviour_map) AS c""")

cte("bootgroup", """
SELECT source, row_number() OVER (ORDER BY md5(source), source) AS no, count(*) OVER () AS groups
FROM (SELECT DISTINCT source FROM graded) AS g""")
cte("bootweight", """
SELECT d.replicate, g.source, count(*) AS w FROM (
  SELECT r AS replicate, CAST('0x' || substr(md5('boot|' || r || '|' || no), 1, 8) AS BIGINT) % groups + 1 AS drawn
  FROM bootgroup CROSS JOIN (SELECT unnest(range(40)) AS r) AS k) AS d JOIN bootgroup AS g ON g.no = d.drawn GROUP BY 1, 2""")
cte("bootrow", """
SELECT replicate, copy, doc_id, toxic, score, score2 FROM (
  SELECT w.replicate, g.*, unnest(range(w.w)) AS copy FROM graded AS g JOIN bootweight AS w USING (source)) AS b""")
cte("boot", f"""
SELECT a.replicate, a.ap AS ap_score, b.ap AS ap_score2, b.ap - a.ap AS delta
FROM ({ap('bootrow', 'score', 'toxic = 1', 'doc_id, copy', 'replicate')}) AS a
JOIN ({ap('bootrow', 'score2', 'toxic = 1', 'doc_id, copy', 'replicate')}) AS b USING (replicate)""")
oracle("paired_bootstrap", "replicate ~ap_score ~ap_score2 ~delta", "SELECT * FROM boot")
oracle("paired_bootstrap_summary", "~mean_delta ~low ~high ~p_improves", """
SELECT avg(delta) AS mean_delta, list_sort(list(delta))[1 + CAST(floor(0.025 * 39 + 0.5) AS BIGINT)] AS low,
  list_sort(list(delta))[1 + CAST(floor(0.975 * 39 + 0.5) AS BIGINT)] AS high, avg((delta > 0)::INT) AS p_improves
FROM (SELECT round(delta, 9) AS delta FROM boot) AS b""")

cte("found", """SELECT e.*, k.slot FROM evid AS e LEFT JOIN pick AS k
  ON e.p1 = k.p1 AND e.p2 = k.p2 AND e.hand_id = k.hand_id AND k.phase = 'development'""")
oracle("recall_at_k", "k gold found ~recall", """
SELECT k, count(*) AS gold, count(*) FILTER (slot <= k) AS found, count(*) FILTER (slot <= k)::DOUBLE / count(*) AS recall
FROM found CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20, 50]) AS k) AS l GROUP BY 1""")
oracle("recall_by_rank", "evidence_rank gold ~recall", """
SELECT evidence_rank, count(*) AS gold, avg(coalesce(slot <= 5, false)::INT) AS recall FROM found GROUP BY 1""")
oracle("precision_by_slot", "slot picks ~precision", """
SELECT k.slot, count(*) AS picks, avg((e.hand_id IS NOT NULL)::INT) AS precision
FROM pick AS k SEMI JOIN evid AS g ON k.p1 = g.p1 AND k.p2 = g.p2
LEFT JOIN evid AS e ON k.p1 = e.p1 AND k.p2 = e.p2 AND k.hand_id = e.hand_id
WHERE k.phase = 'development' AND k.slot <= 5 GROUP BY 1""")

cte("goldhand", """
SELECT s.*, (e.hand_id IS NOT NULL)::INT AS gold
FROM (SELECT * FROM sig WHERE phase = 'development') AS s SEMI JOIN evid AS g ON s.p1 = g.p1 AND s.p2 = g.p2
LEFT JOIN evid AS e ON s.p1 = e.p1 AND s.p2 = e.p2 AND s.hand_id = e.hand_id""")
oracle("within_pair_auc", "p1 p2 rows pos ~auc", """
SELECT p1, p2, count(*) AS rows, sum(gold) AS pos,
  (sum(rk) FILTER (gold = 1) - sum(gold) * (sum(gold) + 1) / 2.0) / (sum(gold) * (count(*) - sum(gold))) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY p1, p2 ORDER BY score) + (count(*) OVER (PARTITION BY p1, p2, score) - 1) / 2.0 AS rk
      FROM (SELECT *, row_number() OVER (PARTITION BY p1, p2 ORDER BY score DESC, hand_id) AS i FROM goldhand) AS g
      WHERE i <= 12) AS b GROUP BY 1, 2 HAVING sum(gold) > 0 AND sum(gold) < count(*)""")
cte("shortlisted", """
SELECT p1, p2, count(*) AS rows, sum(gold) AS pos, max(all_pos) AS all_pos, CASE WHEN sum(gold) > 0 AND sum(gold) < count(*) THEN
  (sum(rk) FILTER (gold = 1) - sum(gold) * (sum(gold) + 1) / 2.0) / (sum(gold) * (count(*) - sum(gold))) END AS auc
FROM (SELECT *, rank() OVER (PARTITION BY p1, p2 ORDER BY score) + (count(*) OVER (PARTITION BY p1, p2, score) - 1) / 2.0 AS rk
      FROM (SELECT *, sum(gold) OVER (PARTITION BY p1, p2) AS all_pos,
                   row_number() OVER (PARTITION BY p1, p2 ORDER BY transfer_gross DESC, hand_id) AS i FROM goldhand) AS g
      WHERE i <= 12) AS b GROUP BY 1, 2""")
oracle("shortlist_auc", "p1 p2 rows pos ~auc all_pos", "SELECT * FROM shortlisted")
oracle("shortlist_summary", "~mean_auc pairs ~recall_inside",
       "SELECT avg(auc) AS mean_auc, count(auc) AS pairs, sum(pos)::DOUBLE / sum(all_pos) AS recall_inside FROM shortlisted")
oracle("separation", "$signal n_pos n_neg ~gap ~welch_t", """
SELECT signal, count(*) FILTER (gold = 1) AS n_pos, count(*) FILTER (gold = 0) AS n_neg,
  avg(z) FILTER (gold = 1) - avg(z) FILTER (gold = 0) AS gap,
  (avg(z) FILTER (gold = 1) - avg(z) FILTER (gold = 0)) / sqrt(var_samp(z) FILTER (gold = 1) / count(*) FILTER (gold = 1)
    + var_samp(z) FILTER (gold = 0) / count(*) FILTER (gold = 0)) AS welch_t
FROM (SELECT signal, gold, (x - avg(x) OVER p) / (stddev_samp(x) OVER p + 1e-9) AS z
      FROM (""" + " UNION ALL ".join(
          f"SELECT '{c}' AS signal, gold, p1, p2, {c}::DOUBLE AS x FROM goldhand"
          for c in ("score", "transfer_gross", "abs_net_gap", "pot_bb"))
       + ") AS u WINDOW p AS (PARTITION BY signal, p1, p2)) AS z GROUP BY 1")

cte("mixrow", """
SELECT share, draw, pid, risk, label = 1 AND family IS DISTINCT FROM 'soft_play' AS known,
  row_number() OVER (PARTITION BY share, draw, label = 1 AND family = 'soft_play' ORDER BY md5(pid || '|mix' || draw), pid) AS i,
  label = 1 AND coalesce(family = 'soft_play', false) AS hidden
FROM riskpair CROSS JOIN (SELECT unnest([0.0, 0.2]) AS share) AS s CROSS JOIN (SELECT unnest(range(5)) AS draw) AS d""")
cte("mix", """
SELECT share, draw, pid, risk, known OR (hidden AND i <= round(share::DOUBLE * count(*) FILTER (known) OVER (PARTITION BY share, draw)
  / (1 - share::DOUBLE))) AS target FROM mixrow""")
oracle("mixture_ap", "~share ~rows ~positives ~ap", f"""
SELECT share, avg(rows) AS rows, avg(positives) AS positives, avg(ap) AS ap FROM ({ap("mix", "risk", "target", "pid", "share, draw")}) AS d GROUP BY 1""")

cte("sweeprow", """
SELECT share, draw, r.pid, r.risk, (c.k_folded_12 + c.k_folded_21)::DOUBLE / c.shared_hands AS fold_rate,
  label = 1 AND family IS DISTINCT FROM 'soft_play' AS known, label = 1 AND coalesce(family = 'soft_play', false) AS hidden,
  row_number() OVER (PARTITION BY share, draw, label = 1 AND family = 'soft_play' ORDER BY md5(r.pid || '|mix' || draw), r.pid) AS i
FROM riskpair AS r JOIN cnt AS c ON c.phase = r.phase AND c.p1 = r.p1 AND c.p2 = r.p2
CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.35]) AS share) AS s CROSS JOIN (SELECT unnest(range(5)) AS draw) AS d""")
cte("sweepmix", """
SELECT 'risk_' || w || '_folds' AS blend, share, draw, pid, round(risk + w::DOUBLE * fold_rate, 9) AS score,
  known OR (hidden AND i <= round(share::DOUBLE * count(*) FILTER (known) OVER (PARTITION BY w, share, draw) / (1 - share::DOUBLE))) AS target
FROM sweeprow CROSS JOIN (SELECT unnest([0.0, 0.5, 2.0]) AS w) AS b""")
oracle("mixture_sweep", "$blend ~share ~rows ~positives ~ap", f"""
SELECT blend, share, avg(rows) AS rows, avg(positives) AS positives, avg(ap) AS ap
FROM ({ap("sweepmix", "score", "target", "pid", "blend, share, draw")}) AS d GROUP BY 1, 2""")

cte("profile0", """
SELECT phase, table_id, p1, p2, count(*) AS hands, count(*) FILTER (a1.n > 0 AND a2.n > 0) AS co_raises,
  count(*) FILTER (both_showdown) AS showdowns,
  count(*) FILTER (both_showdown AND postflop_aggressive_1 = 0 AND postflop_aggressive_2 = 0) AS quiet,
  sum(net_1) AS net_12, sum(net_2) AS net_21
FROM ph AS h
LEFT JOIN (SELECT hand_id, player_id, count(*) AS n FROM act WHERE street = 0 AND y >= 3 GROUP BY 1, 2) AS a1
  ON h.hand_id = a1.hand_id AND h.p1 = a1.player_id
LEFT JOIN (SELECT hand_id, player_id, count(*) AS n FROM act WHERE street = 0 AND y >= 3 GROUP BY 1, 2) AS a2
  ON h.hand_id = a2.hand_id AND h.p2 = a2.player_id GROUP BY 1, 2, 3, 4""")
cte("profile", """
SELECT d.*, coalesce(c.folds, 0) AS folds, coalesce(c.conceded, 0) AS conceded FROM (
  SELECT phase, table_id, p1 AS actor, p2 AS partner, hands, co_raises, showdowns, quiet, net_12 AS net FROM profile0
  UNION ALL SELECT phase, table_id, p2, p1, hands, co_raises, showdowns, quiet, net_21 FROM profile0) AS d
LEFT JOIN (SELECT phase, folder AS actor, target AS partner, count(*) AS folds, sum(better) AS conceded FROM conc GROUP BY 1, 2, 3) AS c
  USING (phase, actor, partner)""")
_PF = (("fold", "folds", "hands"), ("concession", "conceded", "hands"), ("co_raise", "co_raises", "hands"),
       ("quiet_showdown", "quiet", "showdowns"))
oracle("pair_profile", _D + "hands rest_hands folds rest_folds conceded co_raises showdowns quiet net "
       + " ".join(f"~{n}_{s}" for n, _, _ in _PF for s in ("rate", "field", "lift")),
       "SELECT *, " + ", ".join(
           f"CASE WHEN {c} > 0 AND rest_{c} > 0 THEN {n}_rate / {n}_field END AS {n}_lift" for n, c, _ in _PF)
       + " FROM (SELECT *, " + ", ".join(
           f"{c}::DOUBLE / nullif({b}, 0) AS {n}_rate, rest_{c}::DOUBLE / nullif(rest_{b}, 0) AS {n}_field" for n, c, b in _PF)
       + " FROM (SELECT *, " + ", ".join(
           f"sum({c}) OVER a - {c} AS rest_{c}" for c in ("hands", "co_raises", "showdowns", "quiet", "folds", "conceded"))
       + " FROM profile WINDOW a AS (PARTITION BY phase, table_id, actor)) AS m) AS r")

oracle("exposure", "$phase table_id player_id hands slots", """
SELECT phase, table_id, player_id, count(*) AS hands, sum(players_dealt - 1) AS slots FROM seat GROUP BY 1, 2, 3""")

oracle("hand_report", "p1 p2 $hand_id slot big_blind players_dealt ~pot_bb contribution_1 contribution_2 net_1 net_2 best_1 "
       "best_2 strength_rank_1 strength_rank_2 folded_1 folded_2 street part $line", """
SELECT k.p1, k.p2, k.hand_id, k.slot, 10000 AS big_blind, h.* EXCLUDE (p1, p2, hand_id), l.street, l.part, l.line
FROM (SELECT * FROM pick WHERE slot <= 5) AS k
JOIN (SELECT p1, p2, hand_id, players_dealt, pot_bb, contribution_1, contribution_2, net_1, net_2, best_1, best_2,
             strength_rank_1, strength_rank_2, folded_1, folded_2 FROM ph) AS h
  ON k.hand_id = h.hand_id AND k.p1 = h.p1 AND k.p2 = h.p2
JOIN (SELECT hand_id, street, action_no // 512 AS part,
             string_agg(player_id || ' ' || action || ' ' || amount, '; ' ORDER BY action_no) AS line
      FROM log GROUP BY 1, 2, 3) AS l ON k.hand_id = l.hand_id""")

# ---------------------------------------------------------------- blends and routing

cte("three", "SELECT *, transfer_gross::DOUBLE AS flow, round(pot_bb, 6) AS pot, p1 % 5 / 4.0::DOUBLE AS q0, p2 % 7 / 6.0::DOUBLE AS q1 FROM sig")
oracle("rank_blend", _H + "~pct_score ~pct_score2 ~pct_flow ~blend", f"""
SELECT *, 0.25 * pct_score + 0.25 * pct_score2 + 0.5 * pct_flow AS blend FROM (
  SELECT {_KEYS}, hand_id, {', '.join(f'{pct(c, _KEYS)} AS pct_{c}' for c in ('score', 'score2', 'flow'))} FROM three) AS t""")
oracle("routed_blend", _H + "~routed", f"""
SELECT *, 0.5 * (q0 * a + q1 * b) + 0.5 * s AS routed FROM (
  SELECT {_KEYS}, hand_id, q0, q1, {pct('flow', _KEYS)} AS a, {pct('pot', _KEYS)} AS b, {pct('score', _KEYS)} AS s
  FROM three) AS t""")
oracle("tail_guard", _P + "~pct_transfer_total ~pct_both_showdown_rate ~guarded", f"""
SELECT *, greatest(-log10(1 - pct_transfer_total + 1.0 / n), -log10(1 - pct_both_showdown_rate + 1.0 / n) - 0.5) AS guarded FROM (
  SELECT {_KEYS}, count(*) OVER (PARTITION BY phase) AS n, {pct('transfer_total', 'phase')} AS pct_transfer_total,
         {pct('both_showdown_rate', 'phase')} AS pct_both_showdown_rate FROM aggr) AS t""")
cte("ood", f"""
SELECT phase, p1, p2, place <= 300 AS top, round((n - place)::DOUBLE / n * (1 - greatest(a, b, c)) * (1 + 0.2 * -(a * ln(a + 1e-9) + b * ln(b + 1e-9) + c * ln(c + 1e-9))), 9) AS ood,
  CASE WHEN a >= b AND a >= c THEN 'directed_transfer' WHEN b >= c THEN 'soft_play' ELSE 'coordinated_isolation' END AS family_argmax
FROM (SELECT *, 1.0::DOUBLE - a - b AS c FROM (
  SELECT *, (p1 % 4 + 1) / 10.0::DOUBLE AS a, (p2 % 5 + 1) / 10.0::DOUBLE AS b, count(*) OVER () AS n,
    row_number() OVER (ORDER BY shared_hands DESC, phase, p1, p2) AS place FROM cnt) AS r) AS s""")
oracle("route_other", "$phase p1 p2 ~ood $family_argmax $routed", f"""
SELECT phase, p1, p2, ood, family_argmax, CASE WHEN top AND ood >= (SELECT {nearest('ood', 0.95)} FROM ood WHERE top) THEN 'other_coordination' ELSE family_argmax END AS routed
FROM ood""")
oracle("borda_scores", _H + "~borda", f"""
SELECT {', '.join('r.' + k for k in _KEYS.split(', '))}, r.hand_id, coalesce(0.5 * (won / seen + 1 - lost / seen), -1 + 0.001 * place) AS borda
FROM (SELECT *, {pct('score', _KEYS)} AS place FROM ranked) AS r LEFT JOIN (
  SELECT {', '.join('a.' + k for k in _KEYS.split(', '))}, a.hand_id, count(*) AS seen,
    sum(1 / (1 + exp(-(a.score - b.score)))) AS won, sum(1 / (1 + exp(-(b.score - a.score)))) AS lost
  FROM best20 AS a JOIN best20 AS b ON a.phase = b.phase AND a.p1 = b.p1 AND a.p2 = b.p2 AND a.hand_id <> b.hand_id
  GROUP BY ALL) AS c USING ({_KEYS}, hand_id)""")
cte("compared", f"""
SELECT {', '.join('r.' + k for k in _KEYS.split(', '))}, r.hand_id, r.score, coalesce(0.5 * (won / seen + 1 - lost / seen), -1 + 0.001::DOUBLE * place) AS borda
FROM (SELECT *, {pct('score', _KEYS)} AS place FROM sig) AS r LEFT JOIN (
  SELECT {', '.join('a.' + k for k in _KEYS.split(', '))}, a.hand_id, count(*) AS seen,
    sum(floor(1048576 / (1 + exp(-(a.transfer_gross - b.transfer_gross) / 1e6))) / 1048576.0::DOUBLE) AS won, sum(floor(1048576 / (1 + exp(-(b.transfer_gross - a.transfer_gross) / 1e6))) / 1048576.0::DOUBLE) AS lost
  FROM best20 AS a JOIN best20 AS b ON a.phase = b.phase AND a.p1 = b.p1 AND a.p2 = b.p2 AND a.hand_id <> b.hand_id GROUP BY ALL) AS c USING ({_KEYS}, hand_id)""")
oracle("comparator_blend", _H + "~pct_borda ~pct_score ~blend", f"""
SELECT *, 0.5 * pct_borda + 0.5 * pct_score AS blend FROM (
  SELECT {_KEYS}, hand_id, {pct('borda', _KEYS)} AS pct_borda, {pct('score', _KEYS)} AS pct_score FROM compared) AS c""")
oracle("pseudo_labels", "p1 p2 label ~score train_label ~train_weight", """
SELECT p1, p2, label, risk AS score, CASE WHEN label = -1 AND risk >= 0.4 THEN 1 ELSE label END AS train_label,
  CASE WHEN label = -1 AND risk >= 0.4 THEN risk WHEN label = -1 THEN 0.3 ELSE 1 END AS train_weight FROM riskpair""")
cte("strain", """
SELECT r.pid, r.label, r.table_id % 3 AS fold, r.risk AS x0, (c.k_folded_12 + c.k_folded_21)::DOUBLE / c.shared_hands AS x1
FROM riskpair AS r JOIN cnt AS c ON c.phase = r.phase AND c.p1 = r.p1 AND c.p2 = r.p2""")


def ridge_models(name: str, rows: str) -> None:
    """Ridge regression on x0 and x1 for each outer fold f and each fold g left out besides, from rows with f, fold, t, w."""
    cte(f"{name}_sums", f"""
SELECT f, fold AS h, sum(w) AS w, sum(w * x0) AS a, sum(w * x1) AS b, sum(w * x0 * x0) AS aa, sum(w * x0 * x1) AS ab, sum(w * x1 * x1) AS bb,
  sum(w * t) AS t, sum(w * t * x0) AS ta, sum(w * t * x1) AS tb FROM {rows} WHERE w > 0 GROUP BY 1, 2""")
    cte(f"{name}_model", f"""
SELECT f, g, mt - ma * b0 - mb * b1 AS c, b0, b1 FROM (
  SELECT *, (p * d - q * b) / (a * d - b * b) AS b0, (q * a - p * b) / (a * d - b * b) AS b1 FROM (
    SELECT f, g, ma, mb, mt, aa - ma * ma + 1e-3 AS a, ab - ma * mb AS b, bb - mb * mb + 1e-3 AS d, ta - ma * mt AS p, tb - mb * mt AS q FROM (
      SELECT f, g, sum(a) / sum(w) AS ma, sum(b) / sum(w) AS mb, sum(aa) / sum(w) AS aa, sum(ab) / sum(w) AS ab, sum(bb) / sum(w) AS bb,
        sum(t) / sum(w) AS mt, sum(ta) / sum(w) AS ta, sum(tb) / sum(w) AS tb
      FROM {name}_sums CROSS JOIN (SELECT unnest([0, 1, 2]) AS g) AS u WHERE h <> f AND h <> g GROUP BY 1, 2) AS m) AS n) AS o""")


cte("st0", """
SELECT s.*, f, (label = 1)::INT::DOUBLE AS t, CASE label WHEN 1 THEN 10 WHEN 0 THEN 1 ELSE 0.3 END::DOUBLE AS w, false AS conf, false AS was
FROM strain AS s CROSS JOIN (SELECT unnest([0, 1, 2]) AS f) AS u WHERE f <> fold""")
ridge_models("st0", "st0")


def next_round(mode: str, r: int, last: str) -> None:
    take = {"positive": ("conf", "3"), "drop": ("false", "0")}[mode]
    cte(f"st_{mode}{r}", f"""
SELECT pid, label, fold, x0, x1, f, (label = 1 OR {take[0]})::INT::DOUBLE AS t,
  (CASE WHEN label = 1 THEN 10 WHEN label = 0 THEN 1 WHEN conf THEN {take[1]} ELSE 0.3 END)::DOUBLE AS w, conf, was FROM (
  SELECT s.pid, s.label, s.fold, s.x0, s.x1, s.f, s.conf AS was, coalesce(label = -1 AND round(c + b0 * x0 + b1 * x1, 9) > 0.65, false) AS conf
  FROM {last} AS s LEFT JOIN {last}_model AS m ON m.f = s.f AND m.g = s.fold) AS q""")
    ridge_models(f"st_{mode}{r}", f"st_{mode}{r}")


for _mode in ("positive", "drop"):
    next_round(_mode, 1, "st0")
    next_round(_mode, 2, f"st_{_mode}1")


def round_scores(mode: str) -> str:
    return " UNION ALL ".join(f"SELECT pid, label, {r} AS round, c + b0 * x0 + b1 * x1 AS score FROM strain LEFT JOIN {n}_model AS m ON f = fold AND g = fold"
                              for r, n in enumerate(["st0", f"st_{mode}1", f"st_{mode}2"]))


for _mode in ("positive", "drop"):
    cte(f"changes_{_mode}", f"""
SELECT * FROM (SELECT 0 AS round, 0 AS picked, 0 AS changed
      UNION ALL SELECT 1, count(*) FILTER (conf), count(*) FILTER (conf <> was) FROM st_{_mode}1
      UNION ALL SELECT 2, count(*) FILTER (conf), count(*) FILTER (conf <> was) FROM st_{_mode}2) AS r WHERE round = 0 OR changed > 0""")
    cte(f"rounds_{_mode}", f"SELECT *, round(score, 9) AS s FROM ({round_scores(_mode)}) AS u SEMI JOIN changes_{_mode} USING (round)")
_ROUND = """
SELECT '{m}' AS mode, round, picked, changed, w.rows, w.positives, w.ap AS population_ap, l.ap AS labelled_ap FROM changes_{m}
LEFT JOIN ({whole}) AS w USING (round) LEFT JOIN ({known}) AS l USING (round)"""
oracle("self_training_rounds", "$mode round picked changed rows positives ~population_ap ~labelled_ap", " UNION ALL ".join(
    _ROUND.format(m=m, whole=ap(f"rounds_{m}", "s", "label = 1", "pid", "round"),
                  known=ap(f"(SELECT * FROM rounds_{m} WHERE label >= 0) AS q", "s", "label = 1", "pid", "round")) for m in ("positive", "drop")))
oracle("self_training_scores", "pid label round ~score", "SELECT * FROM rounds_positive")

cte("lin", """
SELECT s.*, f, label::DOUBLE AS t, 1.0::DOUBLE AS w FROM strain AS s CROSS JOIN (SELECT unnest([0, 1, 2]) AS f) AS u WHERE label >= 0""")
ridge_models("lin", "lin")
oracle("linear_crossfit", "pid fold ~score", "SELECT pid, fold, c + b0 * x0 + b1 * x1 AS score FROM strain LEFT JOIN lin_model ON f = fold AND g = fold")
cte("cleaned", """
SELECT s.*, x0 AS risk, label = -1 AND coalesce(round(c + b0 * x0 + b1 * x1, 9) > 0.4, false) AS out
FROM strain AS s LEFT JOIN lin_model ON f = fold AND g = fold""")
oracle("precision_variants", "$variant rows positives ~ap", " UNION ALL ".join(
    f"SELECT '{v}' AS variant, * FROM ({ap(f'(SELECT * FROM cleaned WHERE {c}) AS q', 'risk', 'label = 1', 'pid')}) AS a"
    for v, c in (("population", "true"), ("labelled", "label >= 0"), ("cleaned", "NOT out"))))
oracle("linear_crossfit_nested", "pid fold outer_fold ~score",
       "SELECT pid, fold, s.f AS outer_fold, c + b0 * x0 + b1 * x1 AS score FROM lin AS s LEFT JOIN lin_model AS m ON m.f = s.f AND m.g = fold")

oracle("tail_depths", _P + "~fold_depth ~event_depth ~chi2_two ~chi2_six", f"""
SELECT {_KEYS}, {binomial_tail('k_folded_12', 'shared_hands', '0.15::DOUBLE')} AS fold_depth,
  {binomial_tail('k_transfer_event_12', 'shared_hands', '0.4::DOUBLE')} AS event_depth,
  shared_hands / (2 * ln(10)) AS chi2_two,
  -log10(exp(-shared_hands / 2.0::DOUBLE) * (1 + shared_hands / 2.0::DOUBLE + (shared_hands / 2.0::DOUBLE) ** 2 / 2)) AS chi2_six
FROM cnt""")

# ---------------------------------------------------------------- cards

cte("lineact", """
SELECT l_orderkey AS hand_id, l_partkey % 13 AS rank, l_suppkey % 4 AS suit, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS action_no FROM lineitem""")
cte("card", "SELECT hand_id, action_no // 7 AS deal, rank, suit, min(action_no % 7) AS place, count(*) AS lines FROM lineact GROUP BY ALL")


def straight(ranks: str) -> str:
    return (f"coalesce(list_max(list_filter(range(3, 13), lambda t: list_has_all({ranks}, "
            f"[t, t - 1, t - 2, t - 3, CASE WHEN t = 3 THEN 12 ELSE t - 4 END]))), -1)")


cte("cardhand", f"""
SELECT *, {straight('ranks')} AS st, CASE WHEN len(fr) >= 5 THEN {straight('fr')} ELSE -1 END AS sf FROM (
  SELECT c.hand_id, c.deal, c.n_cards, r.g, r.k, r.ranks, coalesce(s.fr, []) AS fr
  FROM (SELECT hand_id, deal, count(*) AS n_cards FROM card GROUP BY 1, 2) AS c
  JOIN (SELECT hand_id, deal, list(n ORDER BY n DESC, rank DESC) AS g, list(rank ORDER BY n DESC, rank DESC) AS k,
               list(rank ORDER BY rank DESC) AS ranks
        FROM (SELECT hand_id, deal, rank, count(*) AS n FROM card GROUP BY 1, 2, 3) AS q GROUP BY 1, 2) AS r USING (hand_id, deal)
  LEFT JOIN (SELECT hand_id, deal, list(rank ORDER BY rank DESC) AS fr FROM card GROUP BY hand_id, deal, suit HAVING count(*) >= 5) AS s
    USING (hand_id, deal)) AS h WHERE n_cards >= 5""")
oracle("best_five", "hand_id deal n_cards category score", """
SELECT *, list_reduce(list_prepend(category::BIGINT, list_transform([1, 2, 3, 4, 5],
         lambda i: coalesce(digits[i], -1)::BIGINT + 1)), lambda a, d: a * 14 + d) AS score FROM (
  SELECT *, CASE category WHEN 8 THEN [sf] WHEN 7 THEN [k[1], list_max(k[2:])] WHEN 6 THEN k[1:2] WHEN 5 THEN fr[1:5]
              WHEN 4 THEN [st] WHEN 3 THEN k[1:3] WHEN 2 THEN [k[1], k[2], list_max(k[3:])] WHEN 1 THEN k[1:4]
              ELSE k[1:5] END AS digits FROM (
    SELECT *, CASE WHEN sf >= 0 THEN 8 WHEN g[1] = 4 THEN 7 WHEN g[1] = 3 AND g[2] >= 2 THEN 6 WHEN len(fr) >= 5 THEN 5
                WHEN st >= 0 THEN 4 WHEN g[1] = 3 THEN 3 WHEN g[1] = 2 AND g[2] = 2 THEN 2 WHEN g[1] = 2 THEN 1 ELSE 0 END AS category
    FROM cardhand) AS a) AS b""")
oracle("draws", "hand_id deal suit_cards rank_run hole_in_suit n_lines", """
SELECT s.hand_id, s.deal, s.n AS suit_cards, r.run AS rank_run, s.n_lines,
  EXISTS (SELECT 1 FROM card AS c WHERE c.hand_id = s.hand_id AND c.deal = s.deal AND c.place < 2 AND c.suit = s.suit) AS hole_in_suit
FROM (SELECT hand_id, deal, suit, count(*) AS n, row_number() OVER (PARTITION BY hand_id, deal ORDER BY count(*) DESC, suit) AS i,
             sum(sum(lines)) OVER (PARTITION BY hand_id, deal) AS n_lines
      FROM card GROUP BY 1, 2, 3) AS s
JOIN (SELECT hand_id, deal, max(n) AS run FROM (
        SELECT hand_id, deal, grp, count(*) AS n FROM (
          SELECT hand_id, deal, rank - row_number() OVER (PARTITION BY hand_id, deal ORDER BY rank) AS grp
          FROM (SELECT DISTINCT hand_id, deal, rank FROM card UNION SELECT hand_id, deal, -1 FROM card WHERE rank = 12) AS d) AS e
        GROUP BY 1, 2, 3) AS f GROUP BY 1, 2) AS r ON s.hand_id = r.hand_id AND s.deal = r.deal WHERE s.i = 1""")
cte("twocard", """
SELECT hand_id, amount, CASE WHEN r0 <> r1 AND s0 = s1 THEN greatest(r0, r1) * 13 + least(r0, r1)
                     ELSE least(r0, r1) * 13 + greatest(r0, r1) END AS bucket FROM (
  SELECT hand_id, max(rank) FILTER (action_no = 0) AS r0, max(rank) FILTER (action_no = 1) AS r1,
         max(suit) FILTER (action_no = 0) AS s0, max(suit) FILTER (action_no = 1) AS s1, max(amount) AS amount
  FROM lineact WHERE action_no < 2 GROUP BY 1) AS t WHERE r1 IS NOT NULL""")
oracle("start_buckets", "hand_id bucket dealt ~win_share ~strength_pct", """
SELECT c.hand_id, c.bucket, t.dealt, t.win_share, t.strength_pct FROM twocard AS c JOIN (
  SELECT *, (rank() OVER (ORDER BY win_share) + (count(*) OVER (PARTITION BY win_share) - 1) / 2.0) / count(*) OVER () AS strength_pct
  FROM (SELECT bucket, count(*) AS dealt, avg((amount > 5000000)::INT) AS win_share FROM twocard GROUP BY 1) AS b) AS t USING (bucket)""")
oracle("parsed_boards", "hand_id deal $board n_cards place rank suit", """
SELECT hand_id, deal, board, n_cards, place, rank, suit FROM (
  SELECT *, string_agg(substr('23456789TJQKA', rank::INT + 1, 1) || substr('cdhs', suit::INT + 1, 1), ' ' ORDER BY place)
              OVER (PARTITION BY hand_id, deal ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS board,
         count(*) OVER (PARTITION BY hand_id, deal) AS n_cards
  FROM (SELECT *, action_no // 5 AS deal, action_no % 5 AS place FROM lineact) AS a) AS b""")
