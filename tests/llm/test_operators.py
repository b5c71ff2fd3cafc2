"""Each operator against a brute-force version on small tables with nulls, empty texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluorite.llm import decontamination, embedding_dedup, language, lm_scoring, ngram_join, packing, pseudonyms, sharding, suffix_dedup, token_output, tokenise

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["the", "of", "Tion", "ing", "éau", "ß", "42", "x.", "and", "or", "near", "far"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(rng.randint(1, 120)) for _ in range(60)]
    out = {i: t for i, t in enumerate(base)}
    out |= {100 + i: t for i, t in enumerate(base[:10])}  # copies
    for i in range(20):  # near copies
        w = base[i + 20].split()
        w[rng.randrange(len(w))] = "changed"
        out[200 + i] = " ".join(w)
    out |= {300: None, 301: "", 302: "   \n", 303: "one", 304: "日本語 text", 305: make(5000), 306: "é" * 200}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, v, "en" if k % 2 else None, "p", k, "names") for k, v in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, p string, kind int, names string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def tokens(t):
    return WORD.findall((t or "").encode().lower())


def test_op1_baseline_and_counts(docs, texts, empty):
    counts = Counter()
    for k, t in texts.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update([*tokens(t), None])
    total, kinds = sum(counts.values()), len(counts)
    got = by_id(lm_scoring.score_texts(docs))
    assert set(got) == set(texts)
    for k, t in texts.items():
        ws = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0 and math.isfinite(r.score)
    assert lm_scoring.score_texts(empty).count() == 0


def test_op1_is_a_distribution():
    rng = np.random.default_rng(3)
    seq = rng.integers(97, 101, 3000).astype(np.uint8)
    keys = lm_scoring.packed_grams(np.concatenate([np.full(2, 10, np.uint8), seq]), np.arange(3002) > 1, 2)
    k, c = np.unique(keys, return_counts=True)
    tree = lm_scoring.SuffixTree({d: (a, b) for d, a, b in lm_scoring._levels(k, c, 2)}, 2, 1.0)
    context = np.uint64(97 << 16 | 98 << 8)
    assert abs((10 ** tree.log10(np.arange(256, dtype=np.uint64) + context)).sum() - 1) < 1e-9


def test_op1_tree_of_all_buckets_keeps_rare_contexts(spark):
    """Scores equal those of one tree over all counts, and contexts far below any share of the corpus count."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["some", "words", "of", "a", "text"]) for _ in range(3000))) for i in range(400)] + [(1000 + i, "qzxj") for i in range(4)]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 1003).collect()}
    grams = []
    for k, t in rows:
        words = lm_scoring.Words(lm_scoring.pa.array([t]))
        seq, scored, _ = lm_scoring.symbols(words, 5)
        grams.append(lm_scoring.packed_grams(seq, scored, 5))
    keys, counts = np.unique(np.concatenate(grams[:-1]), return_counts=True)
    tree = lm_scoring.SuffixTree({d: lm_scoring.frequent(a, b, 2) for d, a, b in lm_scoring._levels(keys, counts, 5)}, 5, 4.0)
    assert all(abs(got[k] - tree.log10(g).sum()) < 1e-6 for (k, _), g in zip(rows, grams))
    assert sum(len(t) for _, t in rows) * 2e-6 > 3 and got[1003] > -8  # "qzxj" is learnt from three texts


def test_op2_predictions(spark, empty):
    rng = random.Random(1)
    say = {"aa": ["ba", "ab", "aba"], "zz": ["zy", "yz", "xyz"]}
    rows = [(i, " ".join(rng.choice(say[lang]) for _ in range(9)), lang) for i, lang in enumerate(["aa", "zz"] * 40)] + [(900, None, "aa"), (901, "12 !", "zz")]
    got = by_id(language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:-2]) and got[900].lang_pred == got[901].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values()) and language.identify(empty).count() == 0


def test_op3_pseudonyms(spark, empty):
    text = "card 4111 1111 1111 1111, 4111111111111111 tel +1 (743) 555-3824 ip 70.23.22.57 m@a.example.com 123-45-6789 2024-02-29 02/30/2001 4111111111111112 999.1.1.1"
    df = spark.createDataFrame([(1, text, "q"), (2, "again 4111111111111111 and 70.23.22.57", "q"), (3, None, "q"), (4, "", "q"), (5, "clean 12 text", "q")], "doc_id long, text string, pseudonyms string")
    got = by_id(pseudonyms.pseudonymise(df, "k"))
    v = [x.value for x in got[1].pseudonyms]
    assert v[0].replace(" ", "") == v[1] == got[2].pseudonyms[0].value and got[2].pseudonyms[1].value == v[3]
    assert not any(x in got[1].text for x in ("4111111111111111", "70.23.22.57", "555-3824", "123-45-6789", "2024-02-29"))
    assert all(x in got[1].text for x in ("02/30/2001", "4111111111111112", "999.1.1.1", "@a.example.com"))
    assert got[3].text is None and got[4].text == "" and got[5].text == "clean 12 text"
    digits = [int(c) for c in v[1]][::-1]
    assert sum(digits[::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10
    assert pseudonyms.pseudonymise(empty).count() == 0


def test_op3_cards_among_other_digits(spark):
    around = {1: ("", " 12/27"), 2: ("", " 123"), 3: ("no 12 ", "."), 4: ("", " 99"), 5: ("1-", "-7 end")}
    rows = [(k, f"{a}4111 1111 1111 1111{b}") for k, (a, b) in around.items()] + [(6, "4111 1111 1111 1112 12/27"), (7, "4111111111111111123"), (8, "378282246310005 1234")]
    got = by_id(pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    for k, (a, b) in around.items():
        new = got[k].pseudonyms[0].value
        assert got[k].text == a + new + b and len(got[k].pseudonyms) == 1 and got[k].pseudonyms[0].kind == "card"
        assert new == got[1].pseudonyms[0].value != "4111 1111 1111 1111" and WORD.findall(new.encode())[0][:1] == b"4"
    assert [got[k].text for k in (6, 7)] == [t for k, t in rows if k in (6, 7)]
    assert got[8].text.endswith(" 1234") and "378282246310005" not in got[8].text


def test_op3_finds_every_value_in_chains_of_digits(spark):
    card = "4111 1111 1111 1111"
    rows = {
        1: f"order 1234 {card} ok", 2: f"12345 {card} 123 {card}", 3: f"{card} 2024-02-29", 4: f"{card} 02/28/2024", 5: f"{card} 415 555 2671",
        6: f"{card} 12345@a.example.com", 7: f"+1 415 555 2671 {card}", 8: f"{card} 70.23.22.57", 9: " ".join(["12"] * 20000) + f" {card}", 10: f"555 2024-02-29 2024-02-28",
    }
    got = by_id(pseudonyms.pseudonymise(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), "k"))
    kinds = {k: [x.kind for x in r.pseudonyms] for k, r in got.items()}
    assert all("1111 1111" not in r.text for r in got.values())
    assert kinds[1] == ["card"] and kinds[2] == ["card"] * 2 and kinds[3] == kinds[4] == ["card", "date"] and kinds[10] == ["date"] * 2
    assert kinds[5] == ["card", "phone"] and kinds[6] == ["card", "email"] and kinds[7] == ["phone", "card"] and kinds[8] == ["card", "ip"] and kinds[9][-1] == "card"
    assert got[1].text.startswith("order 1234 4") and got[2].text.startswith("12345 4") and got[6].text.endswith("@a.example.com")


def test_op3_cards_against_brute_force(spark):
    """In random chains of digit groups, the first and then longest runs of whole groups that pass change, and nothing else."""

    def luhn(digits):
        return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0

    USUAL = [[n] for n in range(13, 20)] + [[4, 4, 4, n] for n in (1, 2, 3, 4)] + [[4, 4, 4, m, n] for m in (1, 2, 3, 4) for n in (1, 2, 3)] + [[4, 6, n] for n in (4, 5)]
    rng = random.Random(9)
    texts = {i: "".join(rng.choice(" -") * (j > 0) + "".join(rng.choices("0123456789", k=rng.choice([1, 2, 4, 4, 4, 5, 6, 16]))) for j in range(rng.randint(1, 14))) for i in range(300)}
    texts = {i: t for i, t in texts.items() if not re.search(f"{pseudonyms.SSN}|{pseudonyms.DATE}|{pseudonyms.PHONE}".replace("*+", "*"), t)}
    got, n = by_id(pseudonyms.pseudonymise(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "k")), 0
    for k, t in texts.items():
        groups, spans, i = [(m.start(), m.end()) for m in re.finditer("[0-9]+", t)], [], 0
        runs = {a: [b for b in reversed(range(a, len(groups))) if 13 <= sum(y - x for x, y in groups[a : b + 1]) <= 19 and luhn("".join(t[x:y] for x, y in groups[a : b + 1]))] for a in range(len(groups))}
        usual = lambda a, b: [y - x for x, y in groups[a : b + 1]] in USUAL  # noqa: B023, E731
        while i < len(groups):
            hides = lambda b: not usual(i, b) and any(usual(c, d) for c in range(i + 1, b + 1) for d in runs[c])  # noqa: B023, E731
            j = next((b for b in runs[i] if not hides(b)), None)
            if j is not None:
                spans.append((groups[i][0], groups[j][1]))
            i = i + 1 if j is None else j + 1
        values, at = [x.value for x in got[k].pseudonyms], 0
        assert len(values) == len(spans)
        for (a, b), v in zip(spans, values):
            assert got[k].text[at:a] == t[at:a] and got[k].text[a:b] == v and luhn(re.sub("[^0-9]", "", v)) and v[0] == t[a] and [c.isdigit() for c in v] == [c.isdigit() for c in t[a:b]]
            at, n = b, n + 1
        assert got[k].text[at:] == t[at:]
    assert n > 50


def test_op3_is_a_permutation(spark):
    n = spark.range(1000).select(pseudonyms.feistel_number(F.col("id"), 40, 25, "k", "t").alias("x")).distinct()
    assert n.count() == 1000 and n.agg(F.min("x"), F.max("x")).first() == (0, 999)


def test_op4_shards(docs, texts, empty):
    got = by_id(sharding.shard_by_bytes(docs))
    sizes = {k: len((t or "").encode()) + 1 for k, t in texts.items()}
    total, before, slots = sum(sizes.values()), 0, Counter()
    for k in sorted(texts):
        shard = min(7, before * 8 // total)
        assert (got[k].size, got[k].shard, got[k].slot, got[k].text_crc32) == (sizes[k], shard, slots[shard], zlib.crc32((texts[k] or "").encode()))
        slots[shard] += 1
        before += sizes[k]
    assert sharding.shard_by_bytes(empty).count() == 0


def test_op5_and_op8_tokens(docs, texts, empty):
    from tokenizers import Tokenizer

    def ids(name, end):
        t = Tokenizer.from_file(tokenise.vocabulary(name))
        return {k: np.array(t.encode(v or "", add_special_tokens=False).ids + [end], "<u4") for k, v in texts.items()}

    want, start, got = ids("byte_bpe_50k.json", 2), 0, by_id(token_output.token_digest(docs))
    for k in sorted(texts):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want[k]), zlib.crc32(want[k].tobytes()))
        start += len(want[k])
    want, rows = ids("word_bpe_49k.json", 0), packing.pack(docs).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in rows} == {(k, a): (len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for k, x in want.items() for a in range(0, len(x), 2048)}
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= 2048
    assert token_output.token_digest(empty).count() == packing.pack(empty).count() == 0


def test_op5_grammars_are_complete():
    """No pair is left that occurs twice without overlap, runs are compressed, and documents open on their own."""
    rng = np.random.default_rng(7)
    line = rng.integers(3, 500, 40)
    cases = [[line] * 50, [np.full(1000, 9)], [rng.integers(3, 9, rng.integers(0, 60)) for _ in range(80)], [np.array([5, 6])] * 3, [np.zeros(0, int)] * 9]
    for parts in cases:
        docs = [np.append(d, 2) for d in parts]
        ids = np.concatenate(docs).astype(np.int32)
        block = token_output.Block(token_output.encode_block(np.arange(len(docs)), ids, np.array([len(d) for d in docs]), 2))
        assert (block.expand(block.symbols) == ids).all() and all((block.document(k) == d).all() for k, d in enumerate(docs))
        ends = {2} | {token_output.RULE + i for i in range(len(block.left)) if block.expand(np.array([token_output.RULE + i], np.int32))[-1] == 2}
        found, last = Counter(), {}
        for i, pair in enumerate(zip(block.symbols[:-1].tolist(), block.symbols[1:].tolist())):
            if pair[0] not in ends and last.get(pair, -2) < i - 1:
                last[pair] = i
                found[pair] += 1
        assert max(found.values(), default=0) < 2
    assert len(token_output.repair(np.full(1 << 12, 9), 2)[0]) <= 2 and len(token_output.repair(np.tile(line, 64), 2)[0]) <= 40


def test_op6_bytes(docs, texts, empty):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    first = {}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            first.setdefault(raw[k][i : i + 50], k)
    got = by_id(suffix_dedup.repeat_digest(docs))
    for k, b in raw.items():
        m = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                m[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, m) if not g)
        assert tuple(got[k])[1:] == (len(b), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[0]), hashlib.sha256(kept).hexdigest()), k
    assert suffix_dedup.repeat_digest(empty).count() == 0


def linked_vectors(rows):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) rows by all pairs; a null id is the smallest."""
    usable = [v is not None and label is not None and any(v) and all(x is not None and math.isfinite(x) for x in v) for _, v, label in rows]
    parent, number = list(range(len(rows))), [0] * len(rows)

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if usable[i] and usable[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1]), np.array(b[1])
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                    number[i], number[j], parent[root(i)] = number[i] + 1, number[j] + 1, root(j)
    key = lambda k: -(2**63) if rows[k][0] is None else rows[k][0]
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), key(k)), key(k))
    out = [(rows[k][0], number[k], least[root(k)]) for k in range(len(rows))]
    return Counter((i, n, None if c == -(2**63) else c, (-(2**63) if i is None else i) == c) for i, n, c in out)


def test_op7_links(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 16))
    x = [base[i % 30] + rng.standard_normal(16) * 0.09 for i in range(150)]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(200 + i, x[0].tolist(), 0) for i in range(5)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, x[1].tolist(), None), (304, [1.0, 2.0], 1), (305, [1.0, None], 1), (306, [2.0, 4.0], 1)]
    rows += [(7, x[5].tolist(), 2), (7, (-x[5]).tolist(), 2), (7, (-x[5]).tolist(), 2), (None, x[30].tolist(), 0), (None, base[3].tolist(), 0)]
    docs = spark.createDataFrame([(*r, 1, "v") for r in rows], "vec_id long, embedding array<double>, label int, component long, vector string").repartition(3)
    got = Counter(tuple(r) for r in embedding_dedup.near_vectors(docs).collect())
    assert got == linked_vectors(rows) and sum(k[1] for k in got) > 100
    assert embedding_dedup.near_vectors(docs.limit(0)).count() == 0


def test_op7_repeated_ids_do_not_share_links(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.01], 0)]
    got = Counter(tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter([(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)])


def test_op7_forest_spans_links():
    rng = np.random.default_rng(4)
    for n, m in ((50, 30), (200, 190), (300, 900), (40, 0)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        parent = list(range(n))
        for _ in range(n):
            for a, b in zip(i.tolist(), j.tolist()):
                parent[a] = parent[b] = min(parent[a], parent[b])
        assert embedding_dedup.forest(n, i, j).tolist() == parent


def test_op9_components(docs, texts, empty):
    sets = {}
    for k, t in texts.items():
        w = tokens(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = by_id(ngram_join.ngram_components(docs))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(s), root(k)) for k, s in sets.items()}
    assert ngram_join.ngram_components(empty).count() == 0


def test_op9_pairs_of_several_trees_come_once():
    """Trees that leave pairs to earlier trees give together what they give on their own, fewer times."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:52], rng.integers(0, 2**63, 8).astype(np.uint64)])) for _ in range(90)]
    trees = {int(t): [k for k in range(90) if rng.random() < 0.4] for t in rng.integers(-(2**62), 2**62, 25)}
    first = {k: sorted(t for t, m in trees.items() if k in m)[: ngram_join.FIRST_TREES] for k in range(90)}

    def walk(lists: bool) -> list[tuple[int, int]]:
        out = []
        for t, m in trees.items():
            earlier = [np.array([x for x in first[k] if x < t], np.int64) for k in m] if lists else None
            tree = ngram_join.CountTree(np.array([len(sets[k]) for k in m]), [ngram_join._unpack(ngram_join._pack(ngram_join.point_of(sets[k]))) for k in m], np.array([k // 2 for k in m]), 75, earlier)
            out += [tuple(sorted((m[i], m[j]))) for i, j in zip(*tree.across())]
        return out

    plain, dealt = walk(False), walk(True)
    assert set(plain) == set(dealt) and len(dealt) < len(plain) / 2 and len(dealt) == len(set(dealt))


def test_near_duplicates_are_decided_by_row(spark):
    """Unlike rows with null or equal ids all stay; of near copies, also within one id, one row stays."""
    import corpus_pipeline

    make = lambda k, n=30: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(None, make(k)) for k in range(40)] + [(5, make(100)), (5, make(101)), (5, make(102)), (3, make(100) + " more"), (7, make(101)), (9, make(102)), (9, make(102)), (11, ""), (11, ""), (None, None), (12, make(0))]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.join_near_duplicates(spark, docs, "").collect())
    want = Counter([(None, make(k)) for k in range(40)] + [(3, make(100) + " more"), (5, make(101)), (5, make(102)), (11, ""), (11, ""), (None, None)])
    assert got == want


def test_op10_windows(spark, docs, texts, empty):
    item = " ".join(texts[305].split()[100:130])
    items = spark.createDataFrame([(1, item), (2, None), (3, "nothing like it anywhere in these many texts at all"), (4, "ONE!")], "item_id long, text string")
    extra = spark.createDataFrame([(900, "before it. " + item.upper().replace("SS", "ß") + "!! after it"), (901, "clean words")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs.select("doc_id", "text").union(extra), items).collect()}
    assert got == {(305, 1), (900, 1), (303, 4)}
    assert {r.doc_id for r in decontamination.clean_documents(docs, items).collect()} == set(texts) - {305, 303}
    assert decontamination.contaminated(docs, items.limit(0)).count() == decontamination.contaminated(empty, items).count() == 0


def test_op10_documents_shorter_than_an_item(spark):
    words = [f"word{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    cut = {1: words[:-1], 2: words[1:], 3: words[:25], 4: words[:24], 5: words[:10], 6: words[:1] + words[2:], 7: words, 8: words[:4]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in cut.items()], "doc_id long, text string")
    got = {r.doc_id: (r.similarity, r.first_word) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {1: (25 / 26, 0), 2: (25 / 26, 0), 3: (21 / 26, 0), 4: (20 / 26, 0), 6: (24 / 27, 0), 7: (1.0, 0)}
    assert {r.doc_id for r in decontamination.clean_documents(docs, items).collect()} == {5, 8}
