"""Small trees and alignments with counts worked out by hand."""

TREE = [("internal-0", "internal-1", 1.0), ("internal-1", "internal-2", 2.0), ("internal-2", "seq1", 3.0), ("internal-2", "seq2", 4.0), ("internal-1", "seq3", 5.0)]
MSA = {"internal-0": "SSIIS", "internal-1": "SSIIS", "internal-2": "TTLLS", "seq1": "TTLLS", "seq2": "TTIIS", "seq3": "SSIIS"}
MSA3 = {"internal-0": "I-I", "seq1": "III", "seq2": "IIL"}
RATES3 = [0.02, 0.03, 0.05]
CONTACTS = {"fam1": ["10101", "01110", "11110", "01111", "10011"], "fam2": ["1010", "0111", "1111", "0111"], "fam3": ["111", "111", "111"]}
TREE6 = [
    ("root", "internal-1", 1.0), ("internal-1", "internal-2", 1.0), ("internal-1", "internal-3", 1.0), ("internal-2", "seq1", 2.0),
    ("internal-2", "internal-4", 1.0), ("internal-3", "internal-5", 1.0), ("internal-3", "seq6", 2.0), ("internal-4", "seq2", 1.0),
    ("internal-4", "seq3", 1.0), ("internal-5", "seq4", 1.0), ("internal-5", "seq5", 1.0),
]


def edge_rows(family, tree):
    seen = {}
    for p, c, t in tree:
        yield family, p, c, seen.setdefault(p, 0), t
        seen[p] += 1


def tiny(spark):
    """Edges, alignments, rates as arrays and contacts of three families."""
    edges = [*edge_rows("fam1", TREE), *edge_rows("fam2", TREE), *edge_rows("fam3", [("internal-0", "seq1", 100.0), ("internal-0", "seq2", 100.0)])]
    msa = [("fam1", n, s) for n, s in MSA.items()] + [("fam2", n, s[:4]) for n, s in MSA.items()] + [("fam3", n, s) for n, s in MSA3.items()]
    rates = [("fam1", [1.0] * 5), ("fam2", [1.0] * 5), ("fam3", RATES3)]
    contacts = [(f, i, j) for f, rows in CONTACTS.items() for i, row in enumerate(rows) for j, c in enumerate(row) if c == "1"]
    return (
        spark.createDataFrame(edges, "family string, parent string, child string, child_ord int, length double"),
        spark.createDataFrame(msa, "family string, seq_name string, seq string"),
        spark.createDataFrame(rates, "family string, rates array<double>"),
        spark.createDataFrame(contacts, "family string, i int, j int"),
    )


def nonzero(counts):
    return {(r.bucket, r.x, r.y): r.n for r in counts.collect() if r.n}


def parsed(**by_bucket):
    """'b0="I>I=2 I>L=4"' as {(0, "I", "I"): 2.0, ...}."""
    out = {}
    for b, text in by_bucket.items():
        for part in text.split():
            move, n = part.split("=")
            out[(int(b[1:]), *move.split(">"))] = float(n)
    return out
