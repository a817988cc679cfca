"""SQL for DuckDB for recursions over trees, level by level from the leaves up and from the root down.

The trees are the test tables' complete binary trees, in which the node with number rn is on level floor(log2(rn + 1)).
"""

from __future__ import annotations

#: Levels of the trees, up to 2 ** LEVELS nodes a family.
LEVELS = 15
STATES = "ACGT"
#: Changes A-G and C-T have a rate of their own.
PARTNER = {"A": "G", "G": "A", "C": "T", "T": "C"}

NODES = """tn AS MATERIALIZED (SELECT n.family, n.node, CAST(floor(log2(n.rn + 1)) AS INTEGER) level, m.seq, NOT EXISTS (SELECT 1 FROM nd c WHERE c.family = n.family AND c.rn = 2 * n.rn + 1) leaf
  FROM nd n JOIN msa m ON m.family = n.family AND m.seq_name = n.node)"""
RATES_OF_ONE = "one AS (SELECT family, site, 1::DOUBLE rate FROM (SELECT DISTINCT family FROM msa), si)"


def _up(name: str, leaf: str, child: dict[str, str], rates: str) -> list[str]:
    """Tables name_<level>(family, node, site, A, C, G, T): leaves as given, inner nodes the sums over their children.

    leaf: the value of state {s} where the letter is c; child: per state what a child adds, given its row v and the time elapsed.
    """
    own = ", ".join(f"{leaf.format(s=s)} {s}" for s in STATES)
    out = []
    for level in range(LEVELS - 1, -1, -1):
        leaves = f"SELECT family, node, site, {own} FROM (SELECT family, node, site, substr(seq, site + 1, 1) c FROM tn, si WHERE level = {level} AND leaf)"
        if level == LEVELS - 1:
            out.append(f"{name}_{level} AS MATERIALIZED ({leaves})")
            continue
        sums = ", ".join(f"sum({child[s]}) {s}" for s in STATES)
        below = f"SELECT v.*, e.parent, e.length * r.rate elapsed, greatest(v.A, v.C, v.G, v.T) most, least(v.A, v.C, v.G, v.T) low FROM {name}_{level + 1} v JOIN edges e ON e.family = v.family AND e.child = v.node JOIN {rates} r ON r.family = v.family AND r.site = v.site"
        out.append(f"{name}_{level} AS MATERIALIZED ({leaves} UNION ALL SELECT family, parent, site, {sums} FROM ({below}) GROUP BY family, parent, site)")
    return out


def likelihood(name: str, rates: str, partner_rate: float, other_rate: float) -> list[str]:
    """Ends in name(family, site, ll): log-likelihood of each site, all states equally likely at the root, unless it is
    the rates' own time."""
    # the two exponentials of a chain in which one change is more frequent than the two others
    slow, fast = f"exp(-elapsed * {4 * other_rate!r}::DOUBLE)", f"exp(-elapsed * {2 * (partner_rate + other_rate)!r}::DOUBLE)"
    same, near, far = f"(0.25::DOUBLE + {slow} / 4 + {fast} / 2)", f"(0.25::DOUBLE + {slow} / 4 - {fast} / 2)", f"(0.25::DOUBLE - {slow} / 4)"
    child = {}
    for s in STATES:
        terms = [f"{same if y == s else near if y == PARTNER[s] else far} * exp({y} - most)" for y in STATES]
        child[s] = f"ln({' + '.join(terms)}) + most"
    up = _up(f"{name}_l", "CASE WHEN c = '{s}' THEN 0::DOUBLE ELSE '-infinity'::DOUBLE END", child, rates)
    root = f"{name} AS (SELECT family, site, ln((exp(A - most) + exp(C - most) + exp(G - most) + exp(T - most)) / 4) + most ll FROM (SELECT *, greatest(A, C, G, T) most FROM {name}_l_0))"
    return [*up, root]


def parsimony() -> list[str]:
    """Ends in anc(family, node, site, k), the chosen states' places, and chg(family, changes)."""
    child = {s: f"least({s}, low + 1)" for s in STATES}
    up = _up("pc", "CASE WHEN c = '{s}' THEN 0::DOUBLE ELSE 1e9::DOUBLE END", child, "one")
    first = "CASE low WHEN A THEN 1 WHEN C THEN 2 WHEN G THEN 3 ELSE 4 END"
    out = [*up, f"pd_0 AS MATERIALIZED (SELECT family, node, site, {first} k, low FROM (SELECT *, least(A, C, G, T) low FROM pc_0))"]
    for level in range(1, LEVELS):
        own = f"SELECT v.*, least(A, C, G, T) low, tn.leaf, u.k up FROM pc_{level} v JOIN tn ON tn.family = v.family AND tn.node = v.node JOIN edges e ON e.family = v.family AND e.child = v.node JOIN pd_{level - 1} u ON u.family = v.family AND u.node = e.parent AND u.site = v.site"
        out.append(f"pd_{level} AS MATERIALIZED (SELECT family, node, site, CASE WHEN [A, C, G, T][up] <= low + CASE WHEN leaf THEN 0 ELSE 1 END THEN up ELSE {first} END k, low FROM ({own}))")
    out.append("anc AS (" + " UNION ALL ".join(f"SELECT family, node, site, k FROM pd_{k}" for k in range(LEVELS)) + ")")
    return [*out, "chg AS (SELECT family, sum(low) changes FROM pd_0 GROUP BY family)"]
