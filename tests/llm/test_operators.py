"""Each operator against brute force, a library, or an exact round trip, on small and awkward tables."""

import collections
import glob
import hashlib
import itertools
import math
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, kernels, language_id, license_scan, registry, token_counts, token_files
from lodestone.llm.bpe_codec import bpe_codec
from lodestone.llm.decontaminate import leaks
from lodestone.llm.embedding_dedup import Coder, embedding_dedup
from lodestone.llm.graph import components
from lodestone.llm.line_dedup import info_name, line_dedup
from lodestone.llm.ngram_jaccard import Bands, ngram_jaccard, signatures, sketch
from lodestone.llm.storage import Scratch
from lodestone.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, cut int"
WORDS = "the heed hand thon erble oust that with from licht und der café Ñandú".split()
VOCAB = bpe.default_vocabulary("word_bpe_49k.json"), bpe.default_vocabulary("byte_bpe_50k.json")


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in texts], SCHEMA)


def awkward(seed=1, n=120):
    rng = random.Random(seed)
    out, base = [], [" ".join(rng.choices(WORDS, k=60)) for _ in range(5)]
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randint(0, 9))
        out.append((i * 3 + 1, " ".join(w)))
    long = " ".join(f"w{i}" for i in range(30000))
    out += [(900, None), (901, ""), (902, "  \n\t "), (903, "one"), (904, "ONE"), (905, "one two"), (906, long), (907, long + " end"), (908, out[0][1]), (908, out[0][1])]
    return out


def grams(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n,num,miss", [(3, 90, 0.0), (5, 80, 1e-4)])
def test_ngram_jaccard(spark, n, num, miss):
    rows = awkward()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(spark, table(spark, rows), n=n, num=num, miss=miss).collect()}
    sets, root = {i: grams(t, n) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= num * (len(sets[a]) + len(sets[b]) - x) and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("n,num", [(5, 80), (3, 60), (2, 45)])
def test_ngram_jaccard_by_prefixes(spark, n, num):
    """Below 0.9: copies with more and more changes, common passages and sets of a few shingles, against all pairs."""
    rng = random.Random(n)
    rows, common = awkward(), " ".join(f"c{i}" for i in range(12))
    for k in range(40):
        words = [f"v{rng.randrange(60 if k % 2 else 10**6)}" for _ in range(rng.randrange(1, 70))]
        for _ in range(6):
            rows.append((10_000 + len(rows), " ".join([common, *words] if k % 3 == 0 else words)))
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            words += words[: rng.randrange(2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(spark, table(spark, rows), n=n, num=num).collect()}
    sets, root = {i: grams(t, n) for i, t in rows}, {i: i for i, _ in rows}
    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if x and 100 * x >= num * (len(sets[a]) + len(sets[b]) - x) and root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {k: lo if v == hi else v for k, v in root.items()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert 0 < sum(i != r for i, r in root.items()) < len(root)


def test_ngram_jaccard_empty_and_null_ids(spark):
    assert ngram_jaccard(spark, table(spark, [])).count() == 0
    got = ngram_jaccard(spark, table(spark, [(None, "a b c d"), (5, "a b c d")])).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("5", 2, "5"), ("None", 2, "None")]


def test_ngram_jaccard_rows_of_one_id_are_one_node(spark):
    rows = [(3, "a b c d"), (7, "a b c d"), (7, "w x y z q"), (9, "w x y z q"), (9, None), (11, "n o p"), (11, "n o p")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(spark, table(spark, rows)).collect())
    assert [(i, n, c) for i, n, c in got if n] == [(3, 2, 3), (7, 2, 3), (7, 3, 3), (9, 3, 3), (11, 1, 11), (11, 1, 11)]


def test_ngram_jaccard_with_a_large_cluster(spark):
    """More near copies than a block holds, in a chain of classes; each is linked with its neighbours only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + 200])) for i in range(180)] + [(1000 + i, " ".join(f"u{i}x{j}" for j in range(40))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard(spark, table(spark, rows)).collect()}
    assert got == {i: 0 if i < 180 else i for i, _ in rows}


def test_signatures_never_miss():
    rng, bands = np.random.default_rng(0), Bands(90, 100)
    for size in (1, 2, 5, 9, 10, 12, 19, 30, 57, 100, 333, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            k = (len(a) * 10) // 190  # keep k swaps within the threshold
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
                assert np.intersect1d(signatures(a, bands), signatures(b, bands)).size


def test_sketches_bound_intersections():
    rng = np.random.default_rng(4)
    for size in (1, 7, 64, 900):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 63, size, dtype=np.uint64)]))
        x, y = (np.frombuffer(sketch(s), "<u4") for s in (a, b))
        assert x.sum() == len(a) and np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("size", [11, 157, 308, 600, 840])
def test_choices_miss_no_more_than_asked(size):
    bands, rng, n = Bands(80, 100, 1e-4), np.random.default_rng(5), 100_000
    tag = bands.tags(size)[0]
    parts, chosen = bands.choices(tag)
    most = bands.low[tag + 1] - 1
    k = 2 * most * 20 // 180
    differ, filled = np.zeros((n, parts), bool), np.zeros((n, parts), bool)
    for mark, m in ((differ, k), (filled, most - k // 2)):
        mark[np.arange(n)[:, None], rng.integers(0, parts, (n, m))] = True
    for c in chosen:
        missed = differ[:, c].any(axis=1) | ~filled[:, c].any(axis=1)
        differ, filled = differ[missed], filled[missed]
    assert len(differ) <= 2e-4 * n


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    for a, b in (e for e in edges if None not in e):
        lo, hi = sorted((root[a], root[b]))
        if lo != hi:
            root = {k: lo if v == hi else v for k, v in root.items()}
    got = {r.node: r.root for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_line_dedup(spark):
    p = "alpha one\nbeta two\ngamma three"
    rows = [(1, f"x\n{p}\ny"), (2, f"{p}\n\nz"), (3, "alpha one\nbeta two"), (4, None), (5, ""), (6, "\n".join(["same"] * 7)), (7, f"q\n  alpha one \nbeta two\n\ngamma three\r\ny"), (8, "\n".join(f"l{i}" for i in range(4000)))]
    got = {r.doc_id: (r.text, r.line_dedup.n_removed) for r in line_dedup(spark, table(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("\nz", 3) and got[3] == (rows[2][1], 0)
    assert got[4] == (None, 0) and got[5] == ("", 0) and got[6] == ("same\nsame\nsame", 4)
    assert got[7] == ("q\n", 4) and got[8][1] == 0  # "gamma three, y" repeats too
    assert line_dedup(spark, table(spark, [])).count() == 0
    assert line_dedup(spark, table(spark, rows)).columns[:-1] == table(spark, rows).columns


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["", " a", "b ", "c", "d\r", "\te", "f g"]) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    first, cut = {}, collections.defaultdict(set)
    for i, t in rows:
        k = [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate(t.split("\n"))]
        k = [r for r in k if r[1]]
        for p in range(len(k) - 2):
            f = first.setdefault(tuple(r[1] for r in k[p : p + 3]), (i, p))
            if f != (i, p):
                cut[i].update(k[q][0] for q in range(p, p + 3) if f[0] != i or q >= f[1] + 3)
    want = {i: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in cut[i]), len(cut[i])) for i, t in rows}
    assert {r.doc_id: (r.text, r.line_dedup.n_removed) for r in line_dedup(spark, table(spark, rows)).collect()} == want


def test_line_dedup_odd_rows(spark):
    p = "alpha\nbeta\ngamma"
    rows = [(None, p), (None, p), (1, p), (1, p), (2, p), (2, "other"), (3, p)]
    df = table(spark, rows).withColumn("line_dedup", F.lit("mine")).withColumn("LINE_DEDUP_", F.lit(1))
    name = info_name(df.columns)
    got = sorted((str(r.doc_id), r.text, r[name].n_removed) for r in line_dedup(spark, df).collect())
    # Null ids stay; the repeated row is one document, the first; a later copy goes.
    assert got == sorted([("None", p, 0)] * 2 + [("1", p, 0)] * 2 + [("2", "", 3), ("2", "other", 0), ("3", "", 3)])
    assert name == "line_dedup__" and line_dedup(spark, df).columns == [*df.columns, name]


def test_leaks_planted(spark):
    """Items copied as they are, with other values throughout, with values that conflict, in part, and not at all."""
    rng = random.Random(8)
    plain = [f"n{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    items = {i: " ".join(str(rng.randint(10, 99)) if k % 6 == 3 else rng.choice(plain) for k in range(24)) for i in range(12)}
    noise = lambda n: " ".join(rng.choice(plain) for _ in range(n))

    def other(t, seed):
        shift = {str(v): str(v + 100 + seed) for v in range(10, 99)}
        return " ".join(shift.get(w, w) for w in t.split())

    rows, want = [], set()
    for i, t in items.items():
        numbers = [k for k, w in enumerate(t.split()) if w.isdigit()]
        clash = t.split()
        for k in numbers:
            clash[k] = "500"  # one value for values that differ
        made = [t, other(t, i), " ".join(t.split()[:18]), " ".join(t.split()[:8]), " ".join(clash), ""]
        for k, text in enumerate(made):
            rows.append((100 * i + k, f"{noise(40)} {text} {noise(40)}"))
            if k < 3:
                want.add((100 * i + k, i))
        if len({t.split()[k] for k in numbers}) < 2:
            want.add((100 * i + 4, i))
    long = noise(60_000)
    rows += [(5000, f"{long} {items[0]} {long}"), (5001, items[1]), (5001, items[1]), (5002, f"{items[2]} {items[2]}")]
    want |= {(5000, 0), (5001, 1), (5002, 2)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in leaks(spark, table(spark, rows), bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leaks_of_equal_items(spark):
    bench = spark.createDataFrame([(1, "the same words in both of the items here"), (2, "The same words in both of the items here"), (1, "the same words in both of the items here")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks(spark, table(spark, [(5, "x the same words in both of the items here y")]), bench).collect())
    assert got == [(5, 1), (5, 2)]


def test_leaks(spark):
    bench = spark.createDataFrame([(1, "A train with 40 cars leaves the station at noon and Alice counts 12 km of track before it stops"), (2, "short question here"), (3, None), (4, "")], "item_id long, text string")
    rows = [(10, "intro words. a train with 55 cars leaves the station at noon and Bob counts 19 km of track before it stops. more"), (11, "a train with 40 cars leaves the station at noon and alice slept"), (12, "see: Short question here!"), (13, "nothing of the kind"), (14, None), (15, ""), (16, "a train with 40 cars leaves the station at noon and Alice counts 12 km of track before it stops"), (None, "short question here")]
    got = {(r.doc_id, r.item_id): r.n_changed for r in leaks(spark, table(spark, rows), bench).collect()}
    assert got == {(10, 1): 3, (12, 2): 0, (16, 1): 0, (11, 1): 0} or got == {(10, 1): 3, (12, 2): 0, (16, 1): 0}
    assert leaks(spark, table(spark, []), bench).count() == 0 and leaks(spark, table(spark, rows), bench.limit(0)).count() == 0


def test_leaks_need_consistent_slots(spark):
    item = "the red box holds 7 pens and the blue box holds 7 pens while the green box holds 9 pens in all"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("7", "3").replace("9", "8")), (2, item.replace("7", "3", 1))]
    assert [r.doc_id for r in leaks(spark, table(spark, rows), bench).collect()] == [1]


def test_leaks_judge_each_occurrence(spark):
    item = "the red box holds 7 pens and the blue box holds 7 pens while the green box holds 9 pens in all"
    runs = "In week 1 he ran 5 miles in the park. In week 2 he ran 7 miles in the park. In week 3 he ran 4 miles in the park."
    bench = spark.createDataFrame([(1, item), (2, runs)], "item_id long, text string")
    other, gap = item.replace("7", "3").replace("9", "8"), " and so on and on" * 5 + " "
    rows = [(1, item + gap + other), (2, other + gap + other.replace("3", "4")), (3, item + gap + "the red box holds 6 pens and the" + gap), (4, "so: " + runs + " end"), (5, item.replace("while", "but while").replace("7", "3", 1)), (6, item.replace("and the", "and then the"))]
    got = {(r.doc_id, r.item_id): (r.covered_words, r.first_word, r.n_changed) for r in leaks(spark, table(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (6, 1)}
    n = len(item.split())
    assert got[1, 1] == (n, 0, 0) and got[2, 1] == (n, 0, 2) and got[3, 1] == (n, 0, 0) and got[4, 2] == (len(runs.split()), 1, 0)


def test_leaks_with_dense_slots(spark):
    plain = "the red box holds 7 pens and the blue box of Alice holds 7 pens in all"
    items = ["What Is The Capital City Of France And Spain Today", "What is 12 + 34 * 56 - 7?", plain]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    copies = [f(t) for t in items for f in (str, str.upper, str.lower, str.title)]
    rows = [(10 + k, f"so it goes: {c} and so on") for k, c in enumerate(copies)] + [(1, "What Is The Chief River Of France Or Spain Now"), (2, "what is 1 and 2 and 3"), (3, plain.upper().replace("7", "3"))]
    got = {(r.doc_id, r.item_id): (r.covered_words, r.n_changed) for r in leaks(spark, table(spark, rows), bench).collect()}
    assert {k: got.get(k) for k in ((10 + k, k // 4) for k in range(12))} == {(10 + k, k // 4): ((10, 0), (6, 0), (17, 0))[k // 4] for k in range(12)}
    assert not {1, 2} & {k[0] for k in got}


@pytest.mark.parametrize("path", VOCAB)
@pytest.mark.parametrize("method", ["trie", "library"])
def test_bpe_codec(spark, path, method):
    rng = random.Random(2)
    odd = "ab ÉßI'sĳ’\n\t 1½<|é漢ΣİǅĦ'llre"
    rows = awkward(n=20) + [(2000 + i, "".join(rng.choice(odd) for _ in range(rng.randint(1, 50)))) for i in range(400)] + [(3000, "<|endoftext|>"), (3001, "it's we'll 'tis  x\n\ny ")]
    lib, want = bpe.library(path), collections.defaultdict(set)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i].add((tuple(ids), lib.decode(ids, skip_special_tokens=False)))
    got = collections.defaultdict(set)
    for r in bpe_codec(table(spark, rows), path, method=method).collect():
        got[r.doc_id].add((struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)), r.decoded))
    assert got == want
    assert bpe_codec(table(spark, []), path).count() == 0


@pytest.mark.parametrize("path", VOCAB)
def test_every_tabled_code_point(path):
    """Words and texts of each tabled code point are cut and encoded as the library does it, and random texts of all scripts."""
    points = [c for a, b in bpe.TABLED for c in range(a, b)] + [c for a, b in bpe.ALL_LETTERS for c in range(a, b, 97)]
    points = [c for c in points if bpe._KIND[c] != bpe.ODD]
    assert len(points) > 18_000 and all(bpe._KIND[ord(c)] != bpe.ODD for c in "яΩ漢字한ひकไعא🙂é̂")
    rows = [f"a{chr(c)}b 1{chr(c)} {chr(c)}. {chr(c)}{chr(c)}z" for c in points]
    rng, mixed = random.Random(3), "ab ÉßI's\n\t ½é́ç̧ 각각 हिन्दी ไทย мир עִב عَرَب Σς <|endoftext|> "
    rows += ["".join(rng.choice(mixed if rng.random() < 0.7 else [chr(c) for c in points[::37]]) for _ in range(rng.randint(0, 60))) + rng.choice(["", " <|endoftext|>x", "<|startoftext|>", " "]) for _ in range(2000)]
    lib = bpe.library(path)
    for method in ("trie", "library"):
        encode, _ = bpe.encoder(path, method)
        for lo in range(0, len(rows), 1000):
            ids, n = encode(rows[lo : lo + 1000])
            want = [e.ids for e in lib.encode_batch_fast(rows[lo : lo + 1000], add_special_tokens=False)]
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_token_files(spark):
    rows = awkward(n=30) + [(None, "no id")]
    root = token_files.write_token_files(spark, table(spark, rows), VOCAB[1], end_id=2)
    got = token_files.read_token_files(spark, root).collect()
    lib, at = bpe.library(VOCAB[1]), 0
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: r.start):
        ids = list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)))
        assert r.start == at and ids in texts[r.doc_id]
        at += r.n_tokens
    named = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert named[0] is None and named[1:] == sorted(named[1:])
    assert [sorted(x.tolist()) for x in token_files.read_document(spark, root, 908)] == [sorted(x) for x in texts[908]]
    assert token_files.read_document(spark, root, 900)[0].tolist() == [2] and token_files.read_document(spark, root, 5_000) == []
    empty = token_files.write_token_files(spark, table(spark, []), VOCAB[1])
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_files_in_a_named_folder(spark, tmp_path):
    """A later session has the folder alone; every byte value comes back from the files."""
    rows = [(i, " ".join(chr(32 + (i * j) % 900) for j in range(300))) for i in range(60)]
    root = token_files.write_token_files(spark, table(spark, rows), VOCAB[1], root=str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.dict"))) == 1 and list((tmp_path / "t" / "shards").glob("part-*"))
    lib = bpe.library(VOCAB[1])
    for i in (0, 17, 59):
        assert token_files.read_document(spark, root, i)[0].tolist() == lib.encode(rows[i][1], add_special_tokens=False).ids
    d = next((tmp_path / "t").glob("*.dict"))
    (tmp_path / "t" / f".{d.name}.crc").unlink(missing_ok=True)
    d.write_bytes(d.read_bytes() + b"x")
    with pytest.raises(ValueError):
        token_files.read_token_files(spark, root)


def test_shard_checks_its_dictionary():
    d = token_files.train_dictionary([b"abcdefgh" * 4] * 3)
    s = token_files.Shard(d, 2)
    image = s.write([(5, np.array([1, 2, 3], np.uint32)), (6, np.zeros(0, np.uint32))])
    assert s.read(image, 0).tolist() == [1, 2, 3] and s.read(image, 1).tolist() == []
    with pytest.raises(ValueError):
        token_files.Shard(d + b"x", 2).read(image, 0)


def test_token_counts(spark):
    n = np.random.default_rng(3).integers(0, 5000, 700)
    df = spark.createDataFrame([(int(x),) for x in n] + [(None,)], "n_tokens long")
    for r in token_counts.length_table(df).collect():
        assert r.docs_from == (n >= r.length).sum() and r.tokens_from == n[n >= r.length].sum()
        assert r.truncated_tokens == np.minimum(n, r.length).sum() and r.tokens_to == n[n <= r.length].sum()
    table_ = token_counts.length_table(df)
    for r in token_counts.at_limits(table_, [0, 17, 2048, 2048, 1 << 40]).collect():
        assert (r.docs_to, r.tokens_to, r.docs_over, r.tokens_over, r.truncated_tokens) == ((n <= r.limit).sum(), n[n <= r.limit].sum(), (n > r.limit).sum(), n[n > r.limit].sum(), np.minimum(n, r.limit).sum())
    assert token_counts.quantile(table_, 0.5).first()[0] == np.sort(n)[349] and token_counts.quantile(table_, 1.0).first()[0] == n.max()
    assert token_counts.length_table(df.limit(0)).count() == token_counts.at_limits(table_.limit(0), [5]).count() == 0
    lib = bpe.library(VOCAB[1])
    rows = awkward(n=10)
    got = collections.Counter((r.doc_id, r.n_tokens) for r in token_counts.token_lengths(table(spark, rows), VOCAB[1]).collect())
    assert got == collections.Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_token_lengths_with_clashing_columns(spark):
    df = table(spark, [(1, "a b"), (1, "a b"), (None, None)]).withColumnRenamed("sig", "n_tokens").withColumnRenamed("cut", "id")
    got = token_counts.token_lengths(df, VOCAB[1])
    assert got.columns == ["doc_id", "n_tokens"] and sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == [("1", 2), ("1", 2), ("None", 0)]


def test_embedding_dedup_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup(spark, spark.createDataFrame([], schema)).count() == 0
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(None, v), (5, v), (5, v), (2, [2 * x for x in v]), (9, [-x for x in v]), (7, [1e-38, 0.0, 0.0, 0.0]), (8, [3e38, 0.0, 0.0, 0.0]), (None, None)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup(spark, spark.createDataFrame(rows, schema).withColumn("key", F.lit(1))).collect())
    assert got == [("2", 2, "2", True), ("5", 2, "2", False), ("5", 2, "2", False), ("7", 1, "7", True), ("8", 1, "7", False), ("9", 0, "9", True), ("None", 0, "None", False), ("None", 0, "None", False)]


@pytest.mark.parametrize("dim", [2, 3, 16, 64, 300])
def test_stored_codes_rule_out_no_link(dim):
    """Estimates are unbiased, and pairs at the threshold stay open but for a normal deviation above four."""
    rng = np.random.default_rng(dim)
    coder = Coder(dim, 40)
    a = rng.normal(size=(400, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = rng.normal(size=(400, dim))
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * e
    one = np.ones(400, int)
    left, right = coder.encode(a, one), coder.encode(b, one)
    i, j = coder.open_pairs(left, right, 0.95)
    assert np.isin(np.arange(400) * 400 + np.arange(400), i * 400 + j).sum() >= 398
    far = rng.normal(size=(400, dim))
    if dim >= 16:
        assert len(coder.open_pairs(left, coder.encode(far, one), 0.95)[0]) < 0.01 * 400 * 400
        x = 2.0 * np.unpackbits(left["code"], axis=1)[:, : coder.signs] - 1
        estimate = ((x @ coder.matrix) * b).sum(1) / math.sqrt(coder.signs * coder.turns) / left["f"]
        assert abs(estimate.mean() - 0.95) < 0.01


def test_embedding_dedup(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 24))
    near = v[:60] + rng.normal(size=(60, 24)) * 0.12
    hot = np.repeat(v[:1], 250, axis=0)
    far = v[1:2] + rng.normal(size=(220, 24)) * rng.uniform(0.02, 0.12, (220, 1))
    x = np.concatenate([v, near, hot, far])
    rows = [(int(i), [float(f) for f in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] + [1.0] * 23), (5004, []), (5005, [1.0, 2.0]), (5006, [2.0, 4.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T >= 0.95
    np.fill_diagonal(c, False)
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(c), strict=True):
        lo, hi = sorted((root[i], root[j]))
        if lo != hi:
            root = [lo if k == hi else k for k in root]
    found = sum(got[i][0] for i in range(len(x)))
    assert found <= c.sum() and found >= 0.99 * c.sum()
    assert np.mean([got[i][1] == root[i] for i in range(len(x))]) > 0.99
    assert all(got[i] == (0, i, True) for i in range(5000, 5005)) and got[5006] == (1, 5005, False)


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/2", "x://example.com", "http://b.net/es/q#f", "http://b.net/de/1", "notcom/en/", None, "", "http://xcom/en/", "http://bad.org/spam/9?ref=q", "http://ok.org/fine/9"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, f"http://s{i}.org/{'spam' if i % 2 else 'fine'}/{i}") for i in range(80)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, None) for i in range(80)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(spark, pages, labels, rules).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "", None, "allow") and got[3] == ("b.net", "/es/q", "net/es/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == got[7] == ("", "", None, "allow") and got[8][2] is None
    assert got[9][3] == "block" and got[10][3] == "allow"
    assert url_filter(spark, pages, labels.limit(0), rules).count() == 91 and url_filter(spark, pages.limit(0), labels, rules).count() == 0


def test_url_filter_host_label_block(spark):
    pages = spark.createDataFrame([(i, f"http://block.s{i}.org/{'spam' if i % 2 else 'fine'}/{i}") for i in range(80)] + [(200, "http://bad.org/spam/9"), (201, "http://block.io/fine/9")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter(spark, pages, labels, []).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(80)} | {200: "block", 201: "allow"}


def test_url_filter_against_brute_force(spark):
    """Every set of tokens of the labelled pages as a rule, against what the mined items decide."""
    from lodestone.llm import url_filter as U

    rng = random.Random(5)
    urls = [f"http://{rng.choice('ab')}.{rng.choice(['x', 'y', 'z'])}.org/{rng.choice(['p', 'q', 'r'])}/{rng.choice(['s', '7', '8'])}" for _ in range(900)]
    bad = lambda u: ("a.x." in u and "/q/" in u and rng.random() < 0.97) or ("/r/s" in u and rng.random() < 0.8) or rng.random() < 0.05
    labels = [(i, 0 if bad(u) else 1, None) for i, u in enumerate(urls[:700])]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(899, urls[899]), (None, urls[0]), (2000, "http://a.x.org/q/" + "long/" * 3000)], "page_id long, url string")
    got = {}
    for r in url_filter(spark, pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [], min_support=0.03).collect():
        assert got.setdefault(r.page_id, r.verdict) == r.verdict
    each = spark.createDataFrame([(u,) for u in {*urls, "http://a.x.org/q/" + "long/" * 3000}], "u string").select("u", U.tokens("u").alias("t")).collect()
    tokens = {r.u: frozenset(r.t) for r in each}
    counts = collections.defaultdict(lambda: [0, 0])
    for i, quality, _ in labels:
        for n in range(1, len(tokens[urls[i]]) + 1):
            for x in itertools.combinations(sorted(tokens[urls[i]]), n):
                counts[x][0] += 1
                counts[x][1] += quality == 0
    z, rules = 3.0, []
    for x, (n, k) in counts.items():
        p = k / n
        low = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        if k >= 0.03 * 700 and p >= 0.6 and low >= 0.6:
            rules.append(frozenset(x))
    assert rules
    want = {i: "block" if any(x <= tokens[u] for x in rules) else "allow" for i, u in enumerate(urls)}
    assert got == want | {None: want[0], 2000: "block" if any(x <= tokens["http://a.x.org/q/" + "long/" * 3000] for x in rules) else "allow"}
    assert set(want.values()) == {"block", "allow"}


def test_license_scan_against_brute_force(spark):
    """Every window against every template; windows that hold much of one, one word changed, or all of it twice."""
    rng = random.Random(9)
    t = {"A": ["one two three four five six seven eight nine ten eleven twelve"], "B": ["red green blue white black grey", " ".join(f"k{i}" for i in range(40))]}
    rows = []
    for i, text in enumerate(x for xs in t.values() for x in xs for _ in range(40)):
        w = text.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        copies = " ".join([*w, *(["gap"] * rng.randint(0, 9)), *w]) if i % 3 == 0 else " ".join(w[: rng.randint(len(w) - 4, len(w))])
        rows.append((i, " ".join(f"f{rng.randint(0, 50)}" for _ in range(rng.randint(0, 30))) + " " + copies.upper() + " tail"))
    rows += [(900, "x " * 50_000 + t["A"][0] + " y" * 50_000), (901, t["A"][0]), (901, t["A"][0]), (None, t["A"][0])]
    want = set()
    for i, text in rows:
        w = re.findall(r"[a-z0-9]+", text.lower())
        for name, text_ in ((n, x) for n, xs in t.items() for x in xs):
            own = text_.split()
            m = 8
            while m < len(own):
                m *= 2
            grams = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            for a in range(0, len(w), m):
                inside = w[a : a + 2 * m]
                if i is not None and len({tuple(inside[k : k + 5]) for k in range(len(inside) - 4)} & grams) >= 0.8 * len(grams):
                    want.add((i, name))
    got = [(r.doc_id, r.license, r.first_word) for r in license_scan.license_scan(table(spark, rows), t).collect()]
    assert {x[:2] for x in got} == want and len(got) == len(set(got)) and {(900, "A"), (901, "A")} <= want
    with pytest.raises(ValueError):
        license_scan.Bands({"long": [" ".join(f"v{i}" for i in range(5))]}, guarantee=1.0)


def test_license_scan(spark):
    t = license_scan.TEMPLATES
    filler = " ".join(f"f{i}" for i in range(50))
    rows = [(k, f"{filler} {text.upper() if k % 2 else text} {filler}") for k, text in enumerate(x for xs in t.values() for x in xs)]
    rows += [(100, filler), (101, None), (102, ""), (103, "Licensed under the moon"), (104, "Released under the MIT License.")]
    got = {(r.doc_id, r.license) for r in license_scan.license_scan(table(spark, rows)).collect()}
    want = {(k, name) for k, (name, _) in enumerate((n, x) for n, xs in t.items() for x in xs)} | {(104, "MIT")}
    assert want <= got and not {d for d, _ in got} & {100, 101, 102, 103}
    assert license_scan.license_scan(table(spark, [])).count() == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.train(spark, d, docs_per_language=32, steps=400)
    got = language_id.identify(spark, d, net).join(d, "doc_id").where(language_id.held_out("doc_id"))
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(spark, table(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "the and of that"), (5, "漢字"), (6, "٣٤")]), net).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[6] == "und" and odd[4] == "en" and odd[5] != "und"
    none = language_id.train(spark, d.limit(0))
    assert {r.lang_pred for r in language_id.identify(spark, d.limit(5), none).collect()} == {"und"}
    x = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", language_id.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in x)


def test_language_id_learns_every_language(spark):
    rows = [(k * 10 + i, f"w{k}x", f"l{k:02d}") for k in range(70) for i in range(10)]
    net = language_id.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=1)
    assert net.languages == sorted({r[2] for r in rows})


def test_language_id_gradient():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"], hidden=5)
    n = rng.integers(1, 7, 12)
    x = np.where(np.arange(6)[None] < n[:, None], rng.integers(97, 103, (12, 6)), 0)
    y = rng.integers(0, 3, 12)
    _, g = net.step(x, n, y)
    for k in net.p:
        flat, own = net.p[k].reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in np.argsort(-np.abs(own))[:6]:
            old, by = flat[i], 1e-2
            flat[i] = old + by
            up, _ = net.step(x, n, y)
            flat[i] = old - by
            down, _ = net.step(x, n, y)
            flat[i] = old
            assert abs((up - down) / (2 * by) - own[i]) < 0.02 * abs(own[i]) + 1e-4, k


def test_language_id_cuts_long_runs_at_characters():
    text = "漢字" * 40 + " abc " + "x" * 100 + " é"
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, at = language_id.units(raw, np.array([0, len(raw)]))
    pieces = [raw[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    assert b"".join(pieces).decode() == text.replace(" ", "") and all(p.decode() and len(p) <= language_id.UNIT for p in pieces) and at.tolist() == [0, len(s)]


def test_language_id_with_repeated_ids_and_long_texts(spark):
    rows = [(i, f"{w} " * (40_000 if i == 1 else 20), lang) for i, (w, lang) in enumerate([("hello the of", "en"), ("licht und der", "de")] * 12)] + [(3, "the of the", "en"), (3, "the hello", "en"), (3, None, "en"), (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_id.train(spark, x, steps=60) for x in (df, df.orderBy(F.desc("text")).repartition(5)))
    assert all((one.p[k] == two.p[k]).all() for k in one.p)
    got = language_id.identify(spark, df.withColumn("lang_pred", F.lit("x")), one).collect()
    assert len(got) == len(rows) and sum(r.lang_pred == "und" for r in got) == 1


TWINS = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{TWINS}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = registry.queries()[name](spark, TWINS).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))


def test_span_hash_tells_spans_apart():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    s = rng.integers(0, 2900, 4000)
    e = s + rng.integers(1, 9, 4000)
    h = kernels.SpanHash(kernels._BYTE[raw])(s, e)
    by = collections.defaultdict(set)
    for k, a, b in zip(h, s, e, strict=True):
        by[int(k)].add(raw[a:b].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({raw[a:b].tobytes() for a, b in zip(s, e, strict=True)})


def test_registered_digests(spark):
    d = "/root/testdata/sf0.001"
    text = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    lib = bpe.library(VOCAB[0])
    for r in registry.op3_bpe(spark, d).collect():
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    lib, at = bpe.library(VOCAB[1]), 0
    for r in registry.op9_token_files(spark, d).orderBy("doc_id").collect():
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
