"""Filter audit, order MinHash and ranked search against brute force, and their awkward cases."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash

from cellcast.llm import filter_audit, lexical_search, order_minhash
from helpers import DOCS, PROSE, docs, sentence

LABELS = "doc_id long, quality long, toxic long"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


# ---- filter audit ----------------------------------------------------------------------

def failures(text):
    t = text or ""
    w = SPACE.findall(t)
    return {f for f, bad in zip("ABCD", (
        len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        bool(re.search(r"[#$%&*|]", t))), strict=True) if bad}


def audit_by_hand(rows, labels):
    """Applies the filters one after another to every row, for every order."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    judged = []
    for doc_id, text, source in rows:
        fails = failures(text)
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == (text or "") for o in rows):
            fails.add("E")
        judged.append((source or "", doc_id, fails))
    out = {}
    for part in {p for p, *_ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(3)
    varied = " ".join(f"word{k}" for k in range(220))
    pool = [None, "", " \n\t ", varied, varied + " #", varied.upper(), PROSE * 12, PROSE * 12 + "$", "short text", varied + " x", "A" * 500]
    rows = [(k, rng.choice(pool), rng.choice(["a", "b", None, ""])) for k in range(60)]
    return rows + [(None, varied, "a"), (None, varied, "a"), (3, varied, "b"), (3, varied, "b"), (70, sentence("long", 30_000), "c")]


def test_filter_audit_equals_applying_the_filters(spark, tmp_path):
    rows = audit_rows()
    labels = [(k, k % 3 == 0, k % 4 == 0) for k in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, 1)]
    labels = [(i, None if q is None else int(q), None if x is None else int(x)) for i, q, x in labels]
    d = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, source string, mask string, part long")
    got = filter_audit.audit_documents(d, spark.createDataFrame(labels, LABELS), str(tmp_path / "a")).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got} == audit_by_hand(rows, labels)


def test_filter_audit_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.audit_documents(empty, spark.createDataFrame([], LABELS), str(tmp_path / "a")).count() == 0
    one = docs(spark, ["a"])
    assert filter_audit.audit_documents(one, spark.createDataFrame([], LABELS), str(tmp_path / "b")).count() == 600


def test_gray_walk_equals_counting_each_state():
    cells = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    alive = filter_audit.survivors(cells)
    for state in range(32):
        free = [m for m in range(32) if not m & state]
        assert (alive[:, state] == cells[:, free].sum(1)).all()


# ---- order MinHash ---------------------------------------------------------------------

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values, width=8):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(width, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return signed(seed)


def print_by_hand(text, k=order_minhash.K, picked=order_minhash.PICKED, size=order_minhash.SIZE):
    unspaced = "฀-໿က-႟ក-៿⺀-\U0010ffff"
    tokens = [xx(t) for t in re.findall(rf"[{unspaced}]|[^\x20\x09-\x0D{unspaced}]+", text or "")]
    low = (1 << 28) - 1
    seen, numbered = Counter(), []
    for at in range(max(1, len(tokens) - k + 1) if tokens else 0):
        kmer = xx(*tokens[at:at + k]) >> 28
        number = seen[kmer]
        seen[kmer] += 1
        h = xxhash.xxh64_intdigest(number.to_bytes(4, "little"), seed=xx(kmer) & ((1 << 64) - 1))
        numbered.append(((signed(h) & ~low) | at))
    out = []
    for j in range(size) if numbered else ():
        point = -(1 << 63) + j * ((1 << 64) // size)
        least = sorted(numbered, key=lambda x: (x - point) % (1 << 64))[:picked]
        in_order = sorted(least, key=lambda x: x & low)
        out.append(xx(*[(x >> 28) & ((1 << 36) - 1) for x in in_order]) & 0xFFFFFFFF)
    return out


def like_by_hand(a, b):
    return 1.0 if not a and not b else sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))


def edited_by_hand(rows):
    """Rows by ascending id, a null one first; equal ids by the hash of their text; equal rows once."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (-(1 << 63) if r[0] is None else r[0], xx(r[1])))
    out = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 2
        edited = t[:len(t) - cut] + after[:cut]
        a, b, c = print_by_hand(t), print_by_hand(edited), print_by_hand(after)
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a),
                     "".join(f"{x:08x}" for x in b), like_by_hand(a, b), like_by_hand(a, c))
    return out


TEXTS = [None, "", " ", "one", "one two", PROSE, PROSE, PROSE + PROSE, "the the the the the the", sentence(1, 300), sentence(2, 80),
         "河流沿着旧磨坊的墙流过 村庄", "café \U0001f600 naïve", sentence("long", 30_000)]


@pytest.mark.parametrize("range_bytes", [order_minhash.RANGE_BYTES, 700])
def test_prints_equal_brute_force(spark, tmp_path, range_bytes):
    rows = [(10 * k, t) for k, t in enumerate(TEXTS)] + [(None, PROSE), (None, "x y z"), (30, "same id"), (30, "same id"), (-5, PROSE)]
    d = spark.createDataFrame([(*r, "r", "n") for r in rows], "doc_id long, text string, range string, n string")
    got = order_minhash.edited_documents(d, str(tmp_path / "f"), range_bytes).collect()
    want = edited_by_hand(rows)
    assert len(got) == len(rows)
    text_of = {i: t or "" for i, t in rows if i is not None and i != 30}
    for r in got:
        found = (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
        if r.doc_id in text_of:
            assert found == want[r.doc_id, text_of[r.doc_id]], r.doc_id
        else:
            assert found in [v for (i, _), v in want.items() if i == r.doc_id]


def test_rows_repeated_very_often_are_one_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order_minhash, "REPEATS", 3)
    rows = [(1, "a b c d")] * 11 + [(2, "e f g h"), (None, "n")] + [(None, "m")] * 5
    got = order_minhash.edited_documents(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "f")).collect()
    assert Counter(r.doc_id for r in got) == {1: 11, 2: 1, None: 6}
    want = edited_by_hand(rows)
    assert {r.edited_sha256 for r in got if r.doc_id == 1} == {want[1, "a b c d"][1]}


def test_prints_of_one_and_of_no_document(spark, tmp_path):
    one = order_minhash.edited_documents(docs(spark, [PROSE]), str(tmp_path / "a")).first()
    half = len(PROSE) // 2
    assert one.near_next == 1.0
    assert one.edited_sha256 == hashlib.sha256((PROSE[:len(PROSE) - half] + PROSE[:half]).encode()).hexdigest()
    assert order_minhash.edited_documents(spark.createDataFrame([], DOCS), str(tmp_path / "b")).count() == 0


def test_order_counts(spark, tmp_path):
    """A text whose blocks are moved about keeps its k-mers, yet is less like than one with a few words changed."""
    w = sentence(7, 400).split()
    moved = [x for k in range(39, -1, -1) for x in w[10 * k:10 * k + 10]]
    changed = [f"new{k}" if k % 40 == 0 else x for k, x in enumerate(w)]
    a, b, c = (print_by_hand(" ".join(x)) for x in (w, moved, changed))
    assert like_by_hand(a, b) + 0.2 < like_by_hand(a, c)


# ---- ranked search ---------------------------------------------------------------------

TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def search_by_hand(rows, items):
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, its in wanted.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in its if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:10], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def search_rows():
    rng = random.Random(5)
    pool = "the The old mill mil mills café CAFÉ a_b a b 42 xéy río K K river".split()
    rows = [(k, " ".join(rng.choice(pool) + rng.choice(["", ",", ".", "-q"]) for _ in range(rng.randint(0, 30)))) for k in range(80)]
    return rows + [(90, None), (91, "..."), (5, "the mill the mill"), (5, "the mill the mill"), (None, "old mill river"),
                   (None, "old mill river"), (92, sentence("long", 30_000) + " mill"), (93, "mill\x00river\x7fmill")]


ITEMS = [(1, "The mill, the OLD mill!"), (2, "café 42"), (3, None), (4, "nowhere"), (5, "a_b river"), (5, "mills"),
         (None, "river"), (7, "The mill, the OLD mill!"), (8, "k")]


@pytest.mark.parametrize("block_bytes", [lexical_search.BLOCK_BYTES, 1])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_search, "CELLS", 7)
    rows = search_rows()
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, term long, score string").repartition(3)
    items = spark.createDataFrame([(*r, 2) for r in ITEMS], "item_id long, text string, rank int")
    got = lexical_search.search(d, items, str(tmp_path / "s"), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == search_by_hand(rows, ITEMS)


def test_search_of_empty_tables(spark, tmp_path):
    none, some = spark.createDataFrame([], DOCS), docs(spark, ["the mill"])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k, (d, i) in enumerate([(none, items), (some, items.limit(0)), (none, items.limit(0)), (docs(spark, [None, "?"]), items)]):
        got = lexical_search.search(d, i, str(tmp_path / str(k)))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_scan_reports_whole_terms_only():
    import pyarrow as pa
    n, row, term, tf = lexical_search.scan(pa.array(["there the the", None, "theé the", "the"]), (b"re", b"the"))
    assert n.tolist() == [3, 0, 2, 1]
    assert list(zip(row.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(0, 1, 2), (2, 1, 1), (3, 1, 1)]
