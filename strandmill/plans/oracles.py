"""SQL for DuckDB that says what the queries of the catalogue say."""

from __future__ import annotations

from strandmill.functions.grid import grid, initial_rate_weights, log_gamma_prior, site_rate_grid
from strandmill.plans.catalog import DISTANCE
from strandmill.plans.tree_oracles import NODES, RATES_OF_ONE, likelihood, parsimony


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


GRID = "q(i, t) AS (VALUES " + ", ".join(f"({k}::INTEGER, {t!r}::DOUBLE)" for k, t in enumerate(grid())) + ")"
STEPS = "b AS (SELECT i li, t l, lead(i) OVER (ORDER BY t) ri, lead(t) OVER (ORDER BY t) r FROM q)"


def _quantized(name: str, source: str) -> str:
    """The rows of source whose t is in the grid, and their bucket."""
    return (
        f"{name} AS (SELECT s.*, CAST(CASE WHEN s.t = b.l THEN b.li WHEN s.t / b.l - 1 < b.r / s.t - 1 THEN b.li ELSE b.ri END AS INTEGER) bucket "
        f"FROM {source} s JOIN b ON s.t >= b.l AND (s.t < b.r OR s.t = b.l))"
    )


EVENTS = """tr AS (SELECT * FROM (SELECT user_id family, event_type x, lead(event_type) OVER w y,
  (lead(epoch_us(ts)) OVER w - epoch_us(ts)) / 8.64e10::DOUBLE t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE y IS NOT NULL)"""
LINES = """tr AS (SELECT * FROM (SELECT l_returnflag x1, l_linestatus x2, lead(l_returnflag) OVER w y1, lead(l_linestatus) OVER w y2,
  abs(lead(epoch_us(l_shipdate)) OVER w - epoch_us(l_shipdate)) / 3.1536e14::DOUBLE t FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) WHERE y1 IS NOT NULL)"""
EDGE_COUNTS = "cnt AS (SELECT bucket, x, y, CAST(count(*) AS BIGINT) n FROM qz GROUP BY bucket, x, y)"
STATES = "st AS (SELECT DISTINCT event_type s FROM events WHERE event_type IS NOT NULL)"


def _jtt(name: str, ipw: bool = True, mask: str = "1", most: str = "TRUE") -> str:
    weighted = "sum(CASE WHEN x <> y THEN w END) OVER (PARTITION BY x)" if ipw else f"sum(CASE WHEN x <> y THEN n END) OVER (PARTITION BY x) / (SELECT median(t) FROM q WHERE {most})"
    return f"""{name} AS (SELECT x, y, CASE WHEN x = y THEN -m ELSE m * n / off END q FROM (
  SELECT x, y, n, {weighted} / sum(n) OVER (PARTITION BY x) m, sum(CASE WHEN x <> y THEN n END) OVER (PARTITION BY x) off FROM (
    SELECT x, y, sum(n) n, sum(n / t) w FROM (
      SELECT q.t, a.s x, c.s y, (coalesce(sym.n, 0::DOUBLE) + 1e-8::DOUBLE) * {mask} n
      FROM q CROSS JOIN (SELECT s, row_number() OVER (ORDER BY s) k FROM st) a CROSS JOIN (SELECT s, row_number() OVER (ORDER BY s) k FROM st) c
      LEFT JOIN (SELECT bucket, x, y, sum(n) n FROM (SELECT bucket, x, y, n / 2::DOUBLE n FROM cnt UNION ALL SELECT bucket, y, x, n / 2::DOUBLE FROM cnt) GROUP BY ALL) sym
        ON sym.bucket = q.i AND sym.x = a.s AND sym.y = c.s WHERE {most}) GROUP BY x, y)))"""


EV = (GRID, STEPS, EVENTS, _quantized("qz", "tr"), EDGE_COUNTS)

EMB = """msa AS (SELECT CAST(label AS VARCHAR) family, vec_id seq_name, array_to_string([CASE WHEN v::DOUBLE < -0.085::DOUBLE THEN 'A' WHEN v::DOUBLE < 0 THEN 'C' WHEN v::DOUBLE < 0.085::DOUBLE THEN 'G' ELSE 'T' END
  FOR v IN embedding], '') seq FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"""
DOC = """msa AS (SELECT lang || '_' || source family, doc_id seq_name, regexp_replace(text, '[^a-z]', '-', 'g') seq
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)"""
EDGES = """nd AS (SELECT family, seq_name node, row_number() OVER (PARTITION BY family ORDER BY seq_name) - 1 rn FROM msa),
edges AS (SELECT c.family, p.node parent, c.node child, CAST((c.rn - 1) % 2 AS INTEGER) child_ord, 0.05::DOUBLE + (c.node % 17) / 20::DOUBLE length
  FROM nd c JOIN nd p ON p.family = c.family AND p.rn = (c.rn - 1) // 2 WHERE c.rn > 0)"""
LEAVES = "leaves AS (SELECT family, child node FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges p WHERE p.family = e.family AND p.parent = e.child))"
CHERRY = """pr AS (SELECT family, first(child ORDER BY child_ord) x, last(child ORDER BY child_ord) y, round(first(length ORDER BY child_ord) + last(length ORDER BY child_ord), 6) t
  FROM (SELECT e.*, l.node IS NOT NULL leaf FROM edges e LEFT JOIN leaves l ON l.family = e.family AND l.node = e.child) GROUP BY family, parent HAVING count(*) = 2 AND bool_and(leaf))"""
EDGE_PAIRS = "pr AS (SELECT family, parent x, child y, round(length, 6) t FROM edges)"
#: Pairs at a node are those of its children with an odd number of leaves below, in order.
CHERRYPP = """up(family, leaf, node) AS (SELECT family, node, node FROM leaves UNION ALL SELECT u.family, u.leaf, e.parent FROM up u JOIN edges e ON e.family = u.family AND e.child = u.node),
odd AS (SELECT family, node FROM up GROUP BY family, node HAVING count(*) % 2 = 1),
oc AS (SELECT e.family, e.parent, e.child, e.length, row_number() OVER (PARTITION BY e.family, e.parent ORDER BY e.child_ord) rn, count(*) OVER (PARTITION BY e.family, e.parent) k
  FROM edges e JOIN odd ON odd.family = e.family AND odd.node = e.child),
lk AS (SELECT family, parent, child, length FROM oc WHERE k % 2 = 1 AND rn = k),
rep(family, node, leaf, d) AS (SELECT family, node, node, 0::DOUBLE FROM leaves UNION ALL SELECT r.family, lk.parent, r.leaf, r.d + lk.length FROM rep r JOIN lk ON lk.family = r.family AND lk.child = r.node),
mt AS (SELECT oc.family, oc.parent, oc.rn, rep.leaf, rep.d + oc.length d FROM oc JOIN rep ON rep.family = oc.family AND rep.node = oc.child),
pr AS (SELECT a.family, a.leaf x, c.leaf y, round(a.d + c.d, 6) t FROM mt a JOIN mt c ON c.family = a.family AND c.parent = a.parent WHERE c.rn = a.rn + 1 AND a.rn % 2 = 1)"""
SITES = "si AS (SELECT CAST(unnest(range(64)) AS INTEGER) site)"
RATES = "rt AS (SELECT family, site, 0.25::DOUBLE + ((site * 7 + family::INTEGER * 3) % 8) / 4::DOUBLE rate FROM (SELECT DISTINCT family FROM msa), si)"
CONTACTS = "ct AS (SELECT CAST(a.i AS INTEGER) i, CAST(c.j AS INTEGER) j FROM (SELECT unnest(range(64)) i) a, (SELECT unnest(range(64)) j) c WHERE a.i < c.j AND (a.i * 7 + c.j * 13) % 11 = 0)"
SEQS = "sp AS (SELECT pr.family, pr.x px, pr.y py, pr.t, a.seq xs, c.seq ys FROM pr JOIN msa a ON a.family = pr.family AND a.seq_name = pr.x JOIN msa c ON c.family = pr.family AND c.seq_name = pr.y)"
PER_SITE = "ps AS (SELECT sp.family, sp.px, sp.py, si.site, sp.t, substr(xs, site + 1, 1) x, substr(ys, site + 1, 1) y FROM sp, si)"
RATED = "psr AS (SELECT ps.family, ps.x, ps.y, ps.t * rt.rate t FROM ps JOIN rt ON rt.family = ps.family AND rt.site = ps.site)"
PAIRS = {"edge": (EMB, EDGES, EDGE_PAIRS), "cherry": (EMB, EDGES, LEAVES, CHERRY), "cherrypp": (EMB, EDGES, LEAVES, CHERRYPP)}
P_EQUAL = "ln(CASE WHEN {x} = {y} THEN 0.25::DOUBLE + 0.75::DOUBLE * exp(-({t}) * (4::DOUBLE / 3)) ELSE 0.25::DOUBLE - exp(-({t}) * (4::DOUBLE / 3)) / 4 END)"


def _counts(kind: str) -> str:
    out = _with(GRID, STEPS, *PAIRS[kind], SITES, RATES, SEQS, PER_SITE, RATED, _quantized("qz", "psr"), recursive=kind == "cherrypp")
    if kind == "edge":
        return out + "SELECT bucket, x, y, CAST(count(*) AS DOUBLE) n FROM qz GROUP BY bucket, x, y"
    return out + "SELECT bucket, x, y, count(*) / 2::DOUBLE n FROM (SELECT bucket, x, y FROM qz UNION ALL SELECT bucket, y, x FROM qz) GROUP BY bucket, x, y"


def _co_counts(kind: str) -> str:
    moved = "mv AS (SELECT bucket, substr(xs, i + 1, 1) xi, substr(xs, j + 1, 1) xj, substr(ys, i + 1, 1) yi, substr(ys, j + 1, 1) yj FROM qz, ct WHERE j - i >= " + str(DISTANCE) + ")"
    ways = ["xi || xj, yi || yj", "xj || xi, yj || yi"] + ([] if kind == "edge" else ["yi || yj, xi || xj", "yj || yi, xj || xi"])
    every = " UNION ALL ".join(f"SELECT bucket, {w} FROM mv" for w in ways)
    out = _with(GRID, STEPS, *PAIRS[kind], CONTACTS, SEQS, _quantized("qz", "sp"), moved, f"al(bucket, x, y) AS ({every})", recursive=kind == "cherrypp")
    return out + f"SELECT bucket, x, y, count(*) / {len(ways)}::DOUBLE n FROM al GROUP BY bucket, x, y"


_JTT = _with(*EV, STATES, _jtt("m1"))
_TWO = _with(*EV, STATES, _jtt("m1"), _jtt("m2", ipw=False), "tw AS (SELECT x, y, m1.q qa, m2.q qb FROM m1 JOIN m2 USING (x, y) WHERE x <> y)")
_FAM = "fam AS (SELECT family, count(*) n_sequences, max(length(seq)) n_sites, sum(length(translate(seq, '._-', ''))) r FROM msa GROUP BY family)"
_HIST = "hi AS (SELECT family, site, substr(seq, site + 1, 1) state, CAST(count(*) AS BIGINT) n FROM msa, si GROUP BY ALL)"
_VAR = "va AS (SELECT family, site, CAST(sum((total - n) * n) AS BIGINT) variability FROM (SELECT *, sum(n) OVER (PARTITION BY family, site) total FROM hi) GROUP BY family, site)"
_NEAR = f"sx AS (SELECT DISTINCT site FROM (SELECT i site FROM ct WHERE j - i >= 40 UNION ALL SELECT j FROM ct WHERE j - i >= 40)), sk AS (SELECT CAST(row_number() OVER (ORDER BY site) - 1 AS INTEGER) k, site FROM sx)"
_DIFFER = "list_sum([CASE WHEN substr(a.seq, s + 1, 1) <> substr(c.seq, s + 1, 1) THEN 1 ELSE 0 END FOR s IN range(64)]) / 64::DOUBLE"
_CHERRY_SITES = (EMB, EDGES, LEAVES, CHERRY, SITES, SEQS, PER_SITE)
_SITE_LL = f"sl AS (SELECT family, site, round(sum({P_EQUAL.format(x='x', y='y', t='t')}), 6) ll FROM ps GROUP BY family, site)"
_SITE_COUNTS = (
    *(GRID, STEPS, *PAIRS["cherrypp"], SITES, RATES, SEQS, PER_SITE, _quantized("qz", "ps")),
    "sc AS (SELECT family, site, bucket, x, y, count(*) / 2::DOUBLE n FROM (SELECT family, site, bucket, x, y FROM qz UNION ALL SELECT family, site, bucket, y, x FROM qz) GROUP BY ALL)",
)
_CANDIDATES = "gr(rate, prior) AS (VALUES " + ", ".join(f"({r!r}::DOUBLE, {log_gamma_prior(r)!r}::DOUBLE)" for r in site_rate_grid()) + ")"
_W4 = initial_rate_weights(site_rate_grid(4))
_FIRST, _LAST = grid()[0], grid()[-1]

_TREES = (EMB, EDGES, SITES, NODES)
_BY_FAMILY = "round(sum(ll), 4) ll, CAST(count(*) AS BIGINT) n_sites, round(sum(ll) / count(*), 6) ll_per_site"
NEAR_VECTORS = """pt AS (SELECT CAST(label AS VARCHAR) family, vec_id site, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y, embedding[3]::DOUBLE z FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 2),
ct AS (SELECT a.family, a.site i, b.site j FROM pt a JOIN pt b ON a.family = b.family AND a.site < b.site AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.1)"""
_MATCHING = """o AS (SELECT row_number() OVER (PARTITION BY family ORDER BY i, j) k, family, i, j FROM ct WHERE j - i >= 7),
g(family, k, used, i, j, kept) AS (SELECT DISTINCT family, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), false FROM ct UNION ALL
  SELECT o.family, o.k, CASE WHEN list_contains(used, o.i) OR list_contains(used, o.j) THEN used ELSE used || [o.i, o.j] END, o.i, o.j, NOT (list_contains(used, o.i) OR list_contains(used, o.j)) FROM g JOIN o ON o.family = g.family AND o.k = g.k + 1)"""

ORACLES: dict[str, str] = {
    "pruning_loglik": _with(*_TREES, RATES_OF_ONE, *likelihood("ll1", "one", 1 / 3, 1 / 3)) + "SELECT family, site, round(ll, 6) ll FROM ll1",
    "family_evaluation": _with(*_TREES, RATES, *likelihood("ll1", "rt", 1 / 3, 1 / 3)) + f"SELECT family, {_BY_FAMILY} FROM ll1 GROUP BY family",
    "pair_evaluation": _with(*_TREES, RATES_OF_ONE, *likelihood("ll1", "one", 1 / 3, 1 / 3)) + f"SELECT family, {_BY_FAMILY} FROM ll1 GROUP BY family",
    "model_comparison": _with(*_TREES, RATES_OF_ONE, *likelihood("ll1", "one", 1 / 3, 1 / 3), *likelihood("ll2", "one", 5 / 7, 1 / 7), "f1 AS (SELECT family, sum(ll) ll, count(*) n FROM ll1 GROUP BY family), f2 AS (SELECT family, sum(ll) ll FROM ll2 GROUP BY family)")
    + "SELECT family, model, round(ll, 4) ll, CAST(n AS BIGINT) n_sites, round(ll - base, 4) gain, round((ll - base) / n, 6) gain_per_site FROM (SELECT family, 'equal' model, ll, ll base, n FROM f1 UNION ALL SELECT f1.family, 'unequal', f2.ll, f1.ll, n FROM f1 JOIN f2 ON f2.family = f1.family)",
    "parsimony_states": _with(*_TREES, RATES_OF_ONE, *parsimony()) + "SELECT anc.family, node, string_agg(substr('ACGT', k, 1), '' ORDER BY site) seq, CAST(first(changes) AS BIGINT) changes FROM anc JOIN chg ON chg.family = anc.family GROUP BY anc.family, node",
    "maximal_matching": _with(NEAR_VECTORS, _MATCHING, recursive=True) + "SELECT family, i, j FROM g WHERE kept",
    "site_model_loglik": _with(*_CHERRY_SITES) + f"SELECT family, px tid, round(sum({P_EQUAL.format(x='x', y='y', t='t')}), 4) ll FROM ps GROUP BY family, px",
    "site_rates_by_table": _with(GRID, STEPS, *_CHERRY_SITES, _CANDIDATES, f"cr AS (SELECT family, site, x, y, rate, prior, least(greatest(t * rate, {_FIRST!r}::DOUBLE), {_LAST!r}::DOUBLE) t FROM ps, gr)", _quantized("cq", "cr"), f"ca AS (SELECT family, site, rate, first(prior) + sum({P_EQUAL.format(x='x', y='y', t='q.t')} + {P_EQUAL.format(x='y', y='x', t='q.t')}) ll FROM cq JOIN q ON q.i = cq.bucket GROUP BY family, site, rate)")
    + "SELECT family, site, round(rate, 6) rate FROM (SELECT *, row_number() OVER (PARTITION BY family, site ORDER BY ll DESC, rate) rn FROM ca) WHERE rn = 1",
    "edge_transition_counts": _with(*EV) + "SELECT * FROM cnt",
    "streaming_edge_counts": _with(*EV) + "SELECT * FROM cnt",
    "late_events_edge_counts": _with(*EV) + "SELECT * FROM cnt",
    "edge_counts_symmetrized": _with(*EV) + "SELECT bucket, x, y, sum(n) / 2::DOUBLE n FROM (SELECT bucket, x, y, n FROM cnt UNION ALL SELECT bucket, y, x, n FROM cnt) GROUP BY bucket, x, y",
    "jtt_ipw_rate_matrix": _JTT + "SELECT x, y, round(q, 6) q FROM m1",
    "jtt_median_rate_matrix": _with(*EV, STATES, _jtt("m1", ipw=False)) + "SELECT x, y, round(q, 6) q FROM m1",
    "jtt_ipw_masked": _with(*EV, STATES, _jtt("m1", mask="(CASE WHEN abs(a.k - c.k) <= 2 THEN 1 ELSE 0 END)")) + "SELECT x, y, round(q, 6) q FROM m1",
    "jtt_ipw_max_time": _with(*EV, STATES, _jtt("m1", most="q.t <= 1")) + "SELECT x, y, round(q, 6) q FROM m1",
    "rate_matrix_metrics": _TWO + "SELECT round(max(abs(ln(qa / qb))), 6) l_infty, round(sqrt(avg(ln(qa / qb) ** 2)), 6) rmse, round(exp(max(abs(ln(qa / qb)))) - 1, 6) mre, round(avg(greatest(qa / qb, qb / qa) - 1), 6) mean_relative_error FROM tw",
    "rate_matrix_correlation": _TWO
    + "SELECT round(corr(la, lb), 6) pearson, round(corr(ra, rb), 6) spearman FROM (SELECT la, lb, rank() OVER (ORDER BY la) + (count(*) OVER (PARTITION BY la) - 1) / 2 ra, rank() OVER (ORDER BY lb) + (count(*) OVER (PARTITION BY lb) - 1) / 2 rb FROM (SELECT round(log10(qa), 10) la, round(log10(qb), 10) lb FROM tw))",
    "jump_probabilities": _JTT + "SELECT x, y, round(p, 6) p FROM (SELECT x, y, q / sum(CASE WHEN x = y THEN -q END) OVER (PARTITION BY x) p FROM m1) WHERE x <> y",
    "ranked_rates": _JTT + "SELECT x, y, q, round(q / total, 6) share, CAST(row_number() OVER (ORDER BY q DESC, x, y) AS INTEGER) rank FROM (SELECT x, y, q, sum(q) OVER () total FROM (SELECT x, y, round(q, 6) q FROM m1) WHERE x <> y) WHERE abs(q) >= 0.05",
    "mutation_rate": _JTT + "SELECT round(sum(-q / (SELECT count(*) FROM st)), 6) rate FROM m1 WHERE x = y",
    "chain_product_rate_matrix": _JTT + "SELECT a.x || '.' || c.x || '.' x, a.y || '.' || c.y || '.' y, round((CASE WHEN c.x = c.y THEN a.q ELSE 0 END) + (CASE WHEN a.x = a.y THEN c.q ELSE 0 END), 6) q FROM m1 a, m1 c",
    "co_transition_counts_edge": _with(GRID, STEPS, LINES, _quantized("qz", "tr")) + "SELECT bucket, x, y, count(*) / 2::DOUBLE n FROM (SELECT bucket, x1 || x2 x, y1 || y2 y FROM qz UNION ALL SELECT bucket, x2 || x1, y2 || y1 FROM qz) GROUP BY bucket, x, y",
    "quantized_shipment_times": _with(GRID, STEPS, LINES, _quantized("qz", "tr")) + "SELECT bucket, CAST(count(*) AS BIGINT) n FROM (SELECT bucket FROM qz UNION ALL SELECT -1 FROM tr WHERE t < (SELECT min(t) FROM q) OR t > (SELECT max(t) FROM q)) GROUP BY bucket",
    "msa_family_sizes": _with(DOC, _FAM) + "SELECT family, CAST(n_sequences AS BIGINT) n_sequences, CAST(n_sites AS BIGINT) n_sites FROM fam",
    "msa_dataset_stats": _with(DOC, _FAM) + "SELECT CAST(count(*) AS BIGINT) n_families, CAST(sum(n_sequences) AS BIGINT) n_sequences, CAST(sum(n_sites) AS BIGINT) n_sites, CAST(sum(r) AS BIGINT) n_residues FROM fam",
    "msa_residue_counts": _with(DOC, _FAM) + "SELECT family, CAST(r AS BIGINT) n_residues FROM fam",
    "families_within_cutoff": _with(DOC, _FAM) + "SELECT family, CAST(n_sequences AS BIGINT) n_sequences, CAST(n_sites AS BIGINT) n_sites FROM fam WHERE n_sequences BETWEEN 5 AND 40",
    "msa_encoded": _with(EMB) + "SELECT family, seq_name, array_to_string([instr('ACGT', substr(seq, CAST(s AS INTEGER) + 1, 1)) - 1 FOR s IN range(64)], ' ') codes FROM msa",
    "msa_missing_marked": _with(DOC) + "SELECT family, seq_name, regexp_replace(seq, '[^aeiou]', '-', 'g') seq FROM msa",
    "column_state_histogram": _with(EMB, SITES, _HIST) + "SELECT * FROM hi",
    "column_distinct_states": _with(EMB, SITES, _HIST) + "SELECT family, site, CAST(count(*) AS BIGINT) n_states FROM hi GROUP BY family, site",
    "site_variability": _with(EMB, SITES, _HIST, _VAR) + "SELECT * FROM va",
    "site_initial_rate_bins": _with(
        *(EMB, SITES, _HIST, _VAR, "ra AS (SELECT family, site, row_number() OVER (PARTITION BY family ORDER BY variability, site) - 1 rank FROM va)"),
        "cu(rc, n) AS (VALUES " + ", ".join(f"({k}, floor({w!r}::DOUBLE * 64 + 0.5))" for k, w in enumerate(_W4)) + ")",
        "wk(family, rank, rc) AS (SELECT family, CAST(0 AS BIGINT), CASE WHEN 0 >= (SELECT n FROM cu WHERE rc = 0) THEN 1 ELSE 0 END FROM (SELECT DISTINCT family FROM msa) UNION ALL SELECT w.family, w.rank + 1, least(3, CASE WHEN w.rank + 1 >= cu.n THEN w.rc + 1 ELSE w.rc END) FROM wk w JOIN cu ON cu.rc = w.rc WHERE w.rank < 63)",
        recursive=True,
    )
    + "SELECT ra.family, site, CAST(wk.rc AS INTEGER) category FROM ra JOIN wk ON wk.family = ra.family AND wk.rank = ra.rank",
    "em_step_rate_matrix": _with(
        *(EVENTS, "tk AS (SELECT CASE WHEN x < 'm' THEN 'a' ELSE 'b' END x, CASE WHEN y < 'm' THEN 'a' ELSE 'b' END y, t FROM tr)", GRID, STEPS, _quantized("qz", "tk")),
        "c AS (SELECT x, y, q.t, exp(-2 * q.t) e, CAST(count(*) AS DOUBLE) n FROM qz JOIN q ON q.i = qz.bucket GROUP BY x, y, q.t)",
        "st AS (SELECT unnest(['a', 'b']) s)",
        "w AS (SELECT a.s i, b.s j, t, e, n / (CASE WHEN x = y THEN 1 + e ELSE 1 - e END / 2) w, CASE WHEN x = a.s THEN 1 ELSE -1 END u, CASE WHEN y = b.s THEN 1 ELSE -1 END v FROM c, st a, st b)",
        "g AS (SELECT i, j, sum(w * (t + (u + v) * (1 - e) / 2 + u * v * t * e) / 4) g FROM w GROUP BY i, j)",
    )
    + "SELECT f.i x, f.j y, round(CASE WHEN f.i = f.j THEN -o.g / f.g ELSE f.g / d.g END, 6) q FROM g f JOIN g d ON d.i = f.i AND d.j = f.i JOIN g o ON o.i = f.i AND o.j <> f.i",
    "fast_cherries_in_rounds": _with(EMB) + "SELECT family, count(*) leaves, count(*) sequences, CAST(count(*) % 2 AS BIGINT) alone, count(*) // 2 pairs, CAST(64 AS BIGINT) n_sites, 1.0::DOUBLE mean_rate FROM msa GROUP BY family",
    "site_rates_extended": _with(EMB, SITES, RATES) + "SELECT family, CAST(k AS INTEGER) site, rate FROM rt, (SELECT unnest(range(150)) k) WHERE site = k % 64",
    "contacting_sites": _with(NEAR_VECTORS) + "SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY site) - 1 AS INTEGER) k, site FROM (SELECT family, i site FROM ct WHERE j - i >= 40 UNION SELECT family, j FROM ct WHERE j - i >= 40)",
    "site_subset_msa": _with(EMB, CONTACTS, _NEAR) + "SELECT family, seq_name, string_agg(substr(seq, site + 1, 1), '' ORDER BY k) seq FROM msa, sk GROUP BY family, seq_name",
    "nontrivial_contacts": _with(NEAR_VECTORS) + "SELECT family, i, j FROM ct WHERE j - i >= 7",
    "site_rate_by_num_contacts": _with(EMB, SITES, RATES, CONTACTS, "nc AS (SELECT site, count(*) c FROM (SELECT i site FROM ct WHERE j - i >= 7 UNION ALL SELECT j FROM ct WHERE j - i >= 7) GROUP BY site)")
    + "SELECT CAST(coalesce(c, 0) AS BIGINT) n_contacts, CAST(count(*) AS BIGINT) n, round(avg(rate), 6) mean, round(quantile_cont(rate, 0.5), 6) median, round(quantile_cont(rate, 0.25), 6) q25, round(quantile_cont(rate, 0.75), 6) q75 FROM rt LEFT JOIN nc USING (site) GROUP BY 1",
    "site_pair_cooccurrence": _with(
        *(EMB, SITES, "rs AS (SELECT family, seq_name, site, substr(seq, site + 1, 1) s FROM msa, si WHERE substr(seq, site + 1, 1) IN ('A', 'T'))"),
        "tt AS (SELECT family, count(*) sequences FROM msa GROUP BY family)",
        "bo AS (SELECT a.family, a.site i, c.site j, avg(CASE WHEN a.s || c.s = 'AT' THEN 1::DOUBLE ELSE 0 END) first_second, avg(CASE WHEN a.s || c.s = 'TA' THEN 1::DOUBLE ELSE 0 END) second_first, avg(CASE WHEN a.s || c.s = 'AA' THEN 1::DOUBLE ELSE 0 END) first_first, avg(CASE WHEN a.s || c.s = 'TT' THEN 1::DOUBLE ELSE 0 END) second_second, count(*) total FROM rs a JOIN rs c ON c.family = a.family AND c.seq_name = a.seq_name AND a.site < c.site GROUP BY ALL)",
    )
    + "SELECT bo.family, i, j, round(first_second, 6) first_second, round(second_first, 6) second_first, round(first_first, 6) first_first, round(second_second, 6) second_second, CAST(total AS BIGINT) total FROM bo JOIN tt ON tt.family = bo.family WHERE first_second > 0.2::DOUBLE AND second_first > 0.2::DOUBLE AND total >= sequences / 8::DOUBLE",
    "msa_subsample": _with(EMB)
    + "SELECT family, seq_name, seq FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, md5('0|' || family || '|' || seq_name), seq_name) place FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY seq_name) rn FROM msa)) WHERE place <= 20",
    "sampled_families": _with(DOC) + "SELECT family FROM (SELECT DISTINCT family FROM msa) ORDER BY md5('0|' || family), family LIMIT 10",
    "hamming_pairs": _with(EMB) + f"SELECT a.family, a.seq_name x, c.seq_name y, {_DIFFER} distance FROM msa a JOIN msa c ON c.family = a.family AND a.seq_name < c.seq_name",
    "farthest_sequence": _with(EMB, "fi AS (SELECT family, min(seq_name) x FROM msa GROUP BY family)", f"di AS (SELECT c.family, x, c.seq_name y, {_DIFFER} distance FROM fi JOIN msa a ON a.family = fi.family AND a.seq_name = x JOIN msa c ON c.family = fi.family)")
    + "SELECT family, x, y, distance FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY distance DESC, y) rn FROM di) WHERE rn = 1",
    "price_quantile_bins": "WITH cu AS (SELECT unnest(quantile_cont(l_extendedprice, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) c FROM lineitem), pl AS (SELECT l_extendedprice v, CAST((SELECT count(*) FROM cu WHERE c < l_extendedprice) AS INTEGER) bin FROM lineitem) SELECT bin, CAST(count(*) AS BIGINT) n, round(avg(v), 4) mean, round(quantile_cont(v, 0.25), 4) q25, round(quantile_cont(v, 0.75), 4) q75 FROM pl GROUP BY bin",
    "perfect_binary_tree": _with(EMB, "fs AS (SELECT family, CAST(ceil(log2(count(*) + 1)) AS INTEGER) levels FROM msa GROUP BY family)")
    + "SELECT family, CAST((i - 1) // 2 AS BIGINT) parent, CAST(i AS BIGINT) child, CAST((i - 1) % 2 AS INTEGER) child_ord FROM (SELECT family, unnest(range(1, (1 << levels) - 1)) i FROM fs)",
    "tree_edges": _with(EMB, EDGES) + "SELECT family, 'n' || parent parent, 'n' || child child, child_ord, round(length * 2, 6) length FROM edges",
    "tree_leaves": _with(EMB, EDGES, LEAVES) + "SELECT family, node FROM leaves",
    "tree_internal_nodes": _with(EMB, EDGES) + "SELECT DISTINCT family, parent node FROM edges",
    "tree_roots": _with(EMB, EDGES) + "SELECT DISTINCT family, parent node FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges c WHERE c.family = e.family AND c.child = e.parent)",
    "cherry_pairs": _with(*PAIRS["cherry"]) + "SELECT family, x, y, t FROM pr",
    "cherrypp_pairs": _with(*PAIRS["cherrypp"], recursive=True) + "SELECT family, x, y, t FROM pr",
    "tree_edge_transition_counts": _counts("edge"),
    "cherry_transition_counts": _counts("cherry"),
    "cherrypp_transition_counts": _counts("cherrypp"),
    "tree_edge_co_transition_counts": _co_counts("edge"),
    "cherry_co_transition_counts": _co_counts("cherry"),
    "cherrypp_co_transition_counts": _co_counts("cherrypp"),
    "equ_transition_loglik": _with(*_CHERRY_SITES) + f"SELECT family, px x, py y, round(sum({P_EQUAL.format(x='x', y='y', t='t')}), 6) ll FROM ps GROUP BY family, px, py",
    "equ_loglik_per_site": _with(*_CHERRY_SITES, _SITE_LL) + "SELECT * FROM sl",
    "bootstrap_loglik": _with(*_CHERRY_SITES, _SITE_LL, "fl AS (SELECT family, ll, row_number() OVER (ORDER BY family) - 1 place, count(*) OVER () n FROM (SELECT family, sum(CAST(ll AS DECIMAL(18,6))) ll FROM sl GROUP BY family))")
    + "SELECT CAST(resample AS INTEGER) resample, round(CAST(sum(g.ll) AS DOUBLE), 4) ll FROM (SELECT resample, CAST('0x' || substr(md5(resample || '|' || place), 1, 8) AS BIGINT) % n drawn FROM fl, (SELECT unnest(range(20)) resample)) d JOIN fl g ON g.place = d.drawn GROUP BY resample",
    "site_rate_argmax": _with(*_CHERRY_SITES, _CANDIDATES, f"ca AS (SELECT family, site, rate, round(first(prior) + sum({P_EQUAL.format(x='x', y='y', t='t * rate')} + {P_EQUAL.format(x='y', y='x', t='t * rate')}), 6) ll FROM ps, gr GROUP BY family, site, rate)")
    + "SELECT family, site, round(rate, 6) rate FROM (SELECT *, row_number() OVER (PARTITION BY family, site ORDER BY ll DESC, rate) rn FROM ca) WHERE rn = 1",
    "site_counts": _with(*_SITE_COUNTS, recursive=True) + "SELECT * FROM sc",
    "site_counts_regularized": _with(
        *(*_SITE_COUNTS, f"ms AS (SELECT sc.family, sc.site, sc.bucket own, sum(n) mass, first(least(greatest(q.t * rt.rate, {_FIRST!r}::DOUBLE), {_LAST!r}::DOUBLE)) t FROM sc JOIN q ON q.i = sc.bucket JOIN rt ON rt.family = sc.family AND rt.site = sc.site GROUP BY ALL)"),
        *(_quantized("mq", "ms"), "nt AS (SELECT unnest(['A', 'C', 'G', 'T']) s)"),
        f"pp AS (SELECT mq.family, mq.site, mq.own bucket, a.s x, c.s y, mass * 0.25::DOUBLE * exp({P_EQUAL.format(x='a.s', y='c.s', t='q.t')}) * 0.25::DOUBLE n FROM mq JOIN q ON q.i = mq.bucket, nt a, nt c)",
        recursive=True,
    )
    + "SELECT family, site, bucket, x, y, round(sum(n), 6) n FROM (SELECT family, site, bucket, x, y, n * 0.75::DOUBLE n FROM sc UNION ALL SELECT * FROM pp) GROUP BY ALL",
}

#: The same results by the way of large families.
for _name in ("pruning_loglik", "family_evaluation", "parsimony_states", "cherrypp_pairs", "maximal_matching"):
    ORACLES[f"{_name}_in_rounds"] = ORACLES[_name]
