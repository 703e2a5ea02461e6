"""Near-duplicates, repeated passages, leaks, components and shards against brute force."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cellcast.llm import chunk_dedup, decontaminate, near_dup, sharding
from cellcast.llm.components import components
from helpers import PROSE, docs, sentence, shingles


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark, tmp_path):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame([*links, (5, None), (7, 7)], "x long, y long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.root for r in components(df, str(tmp_path / "c")).collect()}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0), str(tmp_path / "e")).count() == 0


def near_texts():
    rng = random.Random(9)
    base = sentence("a", 200).split()
    out = [None, "", "...", "one two", "one two", "One, two!", " ".join(base), " ".join(base).upper()]
    for k in range(40):  # near copies of one text, more or less changed
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    out += [sentence(i) for i in range(20)] + [sentence(3)] * 3 + [sentence("long", 30_000)]
    return out


@pytest.mark.parametrize("block_shingles", [near_dup.BLOCK_SHINGLES, 2000])
def test_jaccard_classes_equal_brute_force(spark, tmp_path, block_shingles):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root = roots(range(len(sets)), links)
    d = docs(spark, texts, ["rep", "unit"])
    got = near_dup.jaccard_classes(d, str(tmp_path / "n"), block_shingles=block_shingles).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {
        i: (root[i], sum(i in x for x in links)) for i in range(len(sets))}
    if block_shingles == near_dup.BLOCK_SHINGLES:
        left = near_dup.keep_one(d, str(tmp_path / "k"))
        assert left.columns == d.columns
        assert {r.doc_id for r in left.collect()} == set(root.values())


def test_jaccard_links_count_once_where_blocks_are_empty(spark, tmp_path):
    sizes = [2, 3, 4] * 6  # groups of near copies, each in somewhat more blocks than documents
    texts, want = [], []
    for g, n in enumerate(sizes):
        words = sentence(f"g{g}", 200).split()
        want += [(len(texts) + k, len(texts), n - 1) for k in range(n)]
        texts += [" ".join(words[:len(words) - k]) for k in range(n)]
    got = near_dup.jaccard_classes(docs(spark, texts), str(tmp_path / "b"), block_shingles=150).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == want


def test_jaccard_repeated_rows_and_empty_table(spark, tmp_path):
    d = docs(spark, [PROSE, sentence(1)])
    twice = d.unionAll(d).unionAll(d.select(F.lit(None).cast("long").alias("doc_id"), *d.columns[1:]))
    got = near_dup.jaccard_classes(twice, str(tmp_path / "t")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(0, 0, 1)] * 2 + [(1, 1, 1)] * 2
    assert near_dup.keep_one(twice, str(tmp_path / "u")).count() == 4  # two ids, two rows without id
    assert near_dup.jaccard_classes(d.limit(0), str(tmp_path / "e")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = near_dup.fewest_matches()
    assert fewest[16] <= 8 and 0.6 < fewest[224] / 224 < 0.8
    assert all(b - a in (0, 1) for a, b in zip(fewest[1:], fewest[2:]))


def test_repeated_passages_go_and_the_first_stays(spark, tmp_path):
    passage = " ".join(f"passage{k}" for k in range(60))
    texts = [None, "", sentence(0, 80), sentence(1, 40) + "\n" + passage + " " + sentence(2, 40),
             sentence(3, 31) + "  " + passage + "\n" + sentence(4, 55), passage, sentence(0, 80),
             sentence(5, 30) + " common line of seven words only here " + sentence(6, 30),
             sentence(7, 30) + " common line of seven words only here " + sentence(8, 30), "é " * 200, passage + " " + passage]
    d = docs(spark, texts, ["row", "repeats", "removed_"])
    out = chunk_dedup.remove_repeats(d, str(tmp_path / "c"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == [*d.columns, "removed"]
    for i in (0, 1, 2, 3, 7, 8):
        assert got[i].text == texts[i] and not got[i].removed
    assert got[6].text.strip() == ""
    for i in (4, 5, 10):
        assert passage not in got[i].text and got[i].removed
        raw, kept, at = texts[i].encode(), b"", 0
        for s in got[i].removed:
            kept, at = kept + raw[at:s.start], s.stop
        assert (kept + raw[at:]).decode() == got[i].text and got[i].n_chars == len(got[i].text)
    assert sentence(3, 31) in got[4].text and sentence(4, 55) in got[4].text
    assert chunk_dedup.remove_repeats(d.limit(0), str(tmp_path / "e")).count() == 0


def test_passages_just_over_50_words_go_whole(spark, tmp_path):
    rng = random.Random(51)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    first, later, own = [], [], []
    for k in range(1200):
        passage, a, b = prose(rng.randint(51, 60)), "left" + prose(30), prose(30) + "right"
        first.append(f"{prose(30)}x {passage} y{prose(30)}")
        later.append(f"{a}z\n{passage} w{b}")
        own.append(f"{a}z\nw{b}")
    out = chunk_dedup.remove_repeats(docs(spark, first + later), str(tmp_path / "p")).collect()
    got = {r.doc_id: r.text for r in out}
    assert [got[k] for k in range(len(first))] == first
    missed = [k for k, text in enumerate(own) if got[len(first) + k] != text]
    assert not missed, (len(missed), [got[len(first) + k] for k in missed[:2]])


def word_spans(text):
    """Words as the operator counts them: characters of Han, kana, Thai and Lao one by one."""
    return [m.span() for m in re.finditer("[\u3000-\u9fff\u0e00-\u0eff]|[^\x20\t-\r\u3000-\u9fff\u0e00-\u0eff]+", text)]


def repeated_words(texts, n=50):
    """Per text, which words lie in a run of ``n`` that stands earlier, in this text or another."""
    first, out = {}, []
    for i, text in enumerate(texts):
        words = [text[a:b] for a, b in word_spans(text)]
        mine = [False] * len(words)
        for k in range(len(words) - n + 1):
            if first.setdefault(tuple(words[k:k + n]), (i, k)) != (i, k):
                mine[k:k + n] = [True] * n
        out.append(mine)
    return out


def passage_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    numbers = " ".join(str(k) for k in range(1, 301))
    han = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(300))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(200))
    held = ["buy now " * 40, "call us today for free " * 20, numbers, han, thai, "0 " * 90, prose(51), prose(400)]
    texts = [f"{prose(40)}\n{p} {prose(30)}" for p in held for _ in range(3)]
    lines = [prose(20) for _ in range(12)]  # shared by all, each too short to go
    texts += ["\n".join(f"{x} {prose(15)}" for x in rng.sample(lines, 8)) for _ in range(20)]
    # Every chunk of the passage may belong to an earlier text that holds a part of it.
    pieces = [prose(30) for _ in range(5)]
    texts += [f"{prose(20)} {p} {prose(20)}" for p in pieces]
    texts += [f"{prose(20)} {' '.join(pieces)} {prose(20)}" for _ in range(4)]
    return texts


def test_passages_equal_brute_force(spark, tmp_path):
    texts = passage_texts()
    got = {r.doc_id: r for r in chunk_dedup.remove_repeats(docs(spark, texts), str(tmp_path / "f")).collect()}
    for i, repeated in enumerate(repeated_words(texts)):
        raw = texts[i].encode()
        spans = [(len(raw[:s.start].decode()), len(raw[:s.stop].decode())) for s in got[i].removed]
        gone = [any(a <= x and y <= b for a, b in spans) for x, y in word_spans(texts[i])]
        assert not [k for k, (g, r) in enumerate(zip(gone, repeated, strict=True)) if g and not r], (i, texts[i][:300])
        left, run = 0, 0
        for g, r in zip(gone, repeated, strict=True):
            run = run + 1 if r and not g else 0
            left = max(left, run)
        assert left < 50, (i, left, texts[i][:300])
    after = repeated_words([got[i].text for i in range(len(texts))])
    assert not any(any(x) for x in after)


def test_ties_and_long_chunks():
    import numpy as np
    import pyarrow as pa

    from cellcast.llm.text import utf8
    data, offs = utf8(pa.array(["é " * 500, "a b c d " * 100, "x" * 5000, "日本語" * 100]))
    words = chunk_dedup.text_words(data, offs)
    assert np.diff(words.first).tolist() == [500, 400, 1, 300]
    chunks, n = chunk_dedup.find_chunks(data, offs, words)
    assert n.sum() == 1201 and n.max() <= chunk_dedup.MAX_CHUNK_WORDS
    assert chunks.first[1] > 100 and chunks.first[2] - chunks.first[1] > 20  # periodic texts have chunks


def test_chunks_cover_texts_and_resist_insertions():
    import pyarrow as pa

    from cellcast.llm.text import utf8
    text = sentence("q", 400)
    rows = [text, "inserted here " + text, None, "", " lead and trail \n"]
    data, offs = utf8(pa.array(rows))
    chunks, words = chunk_dedup.find_chunks(data, offs, chunk_dedup.text_words(data, offs))
    cut = [[data[a:b].tobytes() for a, b in zip(chunks.start[i:j], chunks.end[i:j])]
           for i, j in zip(chunks.first[:-1], chunks.first[1:])]
    assert b"".join(cut[0]) == text.encode() and cut[2] == cut[3] == [] and len(cut[4]) == 1
    assert len(set(cut[0]) - set(cut[1])) <= 1 and words.sum() == 400 + 402 + 3


def test_leaks_equal_brute_force(spark, tmp_path):
    items = [(0, sentence("i", 30)), (1, "four words are short"), (2, None), (3, "..."), (4, sentence("j", 45)), (4, sentence("j", 45)),
             (5, sentence("i", 30))]
    w = sentence("i", 30).split()
    texts = [PROSE + sentence("i", 30).upper() + PROSE, " ".join(w[:26]), " ".join(w[:20]), "X four, words are SHORT y", None, "",
             " ".join(w[:15] + ["changed"] + w[16:]), PROSE * 500 + sentence("j", 45), "words are short four"]
    d = docs(spark, texts, ["row", "item_id"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in set(items):
        grams = shingles(t, min(5, len((t or "").split())) or 5) if t and t != "..." else set()
        width = len(next(iter(grams))) if grams else 5
        for k, x in enumerate(texts):
            shared = len(grams & {g for g in shingles(x, width) if len(g) == width})
            if grams and shared >= 0.8 * len(grams) - 1e-9:
                want.add((k, i, len(grams), shared))
    got = {tuple(r)[:4] for r in decontaminate.contaminated_pairs(d, bench).collect()}
    assert got == want and {k for k, *_ in got} == {0, 1, 3, 7, 6} - ({6} if (6, 0, 26, 21) not in want else set())
    clean = decontaminate.drop_contaminated(d, bench)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {k for k, *_ in want}
    assert decontaminate.contaminated_pairs(d, bench.limit(0)).count() == 0
    assert decontaminate.contaminated_pairs(d.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(d, bench.limit(0)).count() == len(texts)
    # Several blocks of items, one at a time: the same pairs, the same rows kept, null texts and repeats included.
    assert len(decontaminate.item_blocks(bench, 100)) > 3
    parts = decontaminate.contaminated_pairs(d, bench, folder=str(tmp_path / "pairs"), block_bytes=100)
    assert sorted(tuple(r)[:4] for r in parts.collect()) == sorted(want)
    twice = d.unionAll(d)
    kept = decontaminate.drop_contaminated(twice, bench, folder=str(tmp_path / "drop"), block_bytes=100)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(2 * [r.doc_id for r in clean.collect()])


def test_item_blocks_hold_all_items(spark):
    bench = spark.createDataFrame([(i, sentence(i, 20)) for i in range(50)], "item_id long, text string")
    blocks = decontaminate.item_blocks(bench, 2000)
    assert len(blocks) > 1 and sorted(r.item_id for b in blocks for r in b.collect()) == list(range(50))


def test_shards_are_near_equal_and_gapless(spark, tmp_path):
    texts = [None, "", "é"] + [PROSE * (i % 5) + str(i) for i in range(600)]
    rows = sharding.records(docs(spark, texts, ["shard", "size"]))
    for r in rows.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    stored = sharding.store_map(sharding.first_map(sharding.slot_bytes(rows)), str(tmp_path / "map"))
    out = sharding.place_rows(rows, sharding.latest(stored)).collect()
    assert len(out) == len(texts) and {r.law for r in out} == {"bytes"}
    size = {s: sum(r.size for r in out if r.shard == s) for s in range(8)}
    assert max(size.values()) - min(size.values()) <= max(r.size for r in out)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))

    grown = sharding.store_map(sharding.grow_map(sharding.latest(stored), 8), str(tmp_path / "map"))
    old = {r.vslot: r.shard for r in grown.filter("version = 1").collect()}
    new = {r.vslot: r.shard for r in sharding.latest(grown).collect()}
    assert len(old) == len(new) == sharding.N_SLOTS
    assert all(new[v] in (old[v], 8) for v in old)
    both = sharding.place_rows(rows, grown.filter("version = 1"), sharding.latest(grown)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in both) == sorted((r.doc_id, r.shard, r.slot) for r in out)
    assert all(r.next_shard == new[r.vslot] for r in both) and {r.next_shard for r in both} == set(range(9))
    moved = sum(r.size for r in out if new[r.vslot] == 8)
    assert 0.6 * sum(size.values()) / 9 < moved <= sum(size.values()) / 9


def test_records_scan_the_texts_once(spark, tmp_path):
    docs(spark, ["a", "b"]).write.parquet(str(tmp_path / "d"))
    plan = sharding.records(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_shards_of_an_empty_table_and_repeated_rows(spark, tmp_path):
    d = docs(spark, ["a", "b"])
    for k, table in enumerate([d.limit(0), d.unionAll(d)]):
        rows = sharding.records(table)
        stored = sharding.store_map(sharding.first_map(sharding.slot_bytes(rows)), str(tmp_path / str(k)))
        out = sharding.place_rows(rows, sharding.latest(stored)).collect()
        assert len(out) == table.count() == len({(r.shard, r.slot) for r in out})


def test_shards_spread_null_and_repeated_ids(spark, tmp_path):
    n = 2500
    rows = [(None, f"text {i}") for i in range(n)] + [(7, f"other {i}") for i in range(n)] + [(8, "same text")] * n
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.records(table)
    found.write.parquet(str(tmp_path / "records"))
    found = spark.read.parquet(str(tmp_path / "records"))
    stored = sharding.store_map(sharding.first_map(sharding.slot_bytes(found)), str(tmp_path / "map"))
    out = sharding.place_rows(found, sharding.latest(stored)).collect()
    want = sorted(((i is None, i or 0), len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in out) == want
    size = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(size) - min(size) <= max(r.size for r in out)
    held = [0] * sharding.N_SLOTS
    for r in out:
        held[r.vslot] += 1
    assert max(held) < 20  # 7500 rows in 4096 slots
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_clashing_ids_lose_no_text(spark, tmp_path):
    """One id on different texts, beside copies and near copies of some of them."""
    a, b, c = sentence("a"), sentence("b"), sentence("c")
    near_a = a.replace("wax7", "other")
    rows = [(1, a), (1, b), (2, c), (1, c), (3, near_a), (3, near_a), (1, a), (4, sentence("d")), (None, a), (None, None), (5, None), (5, "")]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, key string, h string")
    left = sorted(((r.doc_id, r.text) for r in near_dup.keep_one(d, str(tmp_path / "k")).collect()), key=str)
    texts = [t for _, t in left]
    assert texts.count(b) == 1 and texts.count(sentence("d")) == 1 and texts.count(c) == 1
    assert (2, c) in left  # rather than the row that shares its id with other texts
    assert sum(t in (a, near_a) for i, t in left if i is not None) == 1
    assert (None, a) in left and (None, None) in left
    assert sum(i == 5 for i, _ in left) == 1
