"""Each text operator against a plain version, on a small table with every awkward kind of row."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from barspan.llm import bytebpe, classifier, classlm, fingerprints, idfiles, jaccard, packing, pii, rules, tokencounts
from barspan.llm.queries import MERGE_RANKS, PIECE_MODEL, WORD_MODEL, vocabulary
from barspan.llm.text import slices

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeéñßk") for _ in range(rng.randint(1, 6))) for _ in range(n))


def make_texts():
    rng = random.Random(5)
    base = sentence(rng, 120).split()
    texts = [None, "", "   ", "\n\t ", "a", "Two words", "one two three four five", "five six seven eight nine ten"]
    for k in range(12):  # near copies: k words changed
        copy = list(base)
        for j in rng.sample(range(len(copy)), k):
            copy[j] = f"changed{k}x{j}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 4  # copies
    texts += ["short text of just nine words for a set", "short text of just nine words for a sets", "short text of just nine words for other sets"]
    texts += [sentence(rng, rng.randint(1, 300)) for _ in range(20)]
    texts += ["line one\nline two\nline one\n\nline one \n", "w " * 70, "SHOUT!! " * 60, "| nav # * $ " * 40, "x" * 5000, sentence(rng, 30000)]
    texts += ["a \n b", " \n \n", "x  y   z ", "<|endoftext|> and <s> </s>", "日本語 テスト。", "ﬁ É é \xa0 b\x85c　d", "İ K Σ ŉ", "it's, DON'T. 1,234.5", "\x00\x01\x7f", "▁a ▁ b▁ c"]
    texts += [
        "mail a.b%c@mail1.example.com_x@y.z now", "ip 1.2.3.4 and 1.2.3.256 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111, 4111111111111112", "tel +1 (375) 555-4393 and +12 and +1(2)3(4)5(6)7(8)",
        "IBAN GB82 WEST 1234 5698 7654 32 of my bank", "call me: phone 375 555 4393", "order 375 555 4393", "visa credit card 378282246310005",
    ]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with gaps; extra columns named like the operators' own."""
    rows = [(7 * k if k < 40 else 1000 + 13 * k, t, None, k, "x", 1.5) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, word string, score double").repartition(5)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """A row without id and rows that repeat one."""
    return spark.createDataFrame([(None, "a b c"), (None, None), (3, "same id"), (3, "same id"), (3, None), (5, "x")], "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")


# 1 fingerprints


def plain_winnow(text):
    codes = [ord(c) for c in text]
    if not codes:
        return [], []
    gram = min(fingerprints.GRAM, len(codes))
    hashes = [int(fingerprints.gram_hashes(np.array(codes[i : i + gram], np.uint32), gram)[0]) for i in range(len(codes) - gram + 1)]
    width = min(fingerprints.WINDOW, len(hashes))
    chosen = sorted({min(range(i, i + width), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - width + 1)})
    return [hashes[j] for j in chosen], chosen


def test_winnowing_is_the_window_minimum():
    for text in [t for t in TEXTS if t is not None and len(t) < 900] + ["ab" * 200, "a" * 300]:
        hashes, positions = fingerprints.winnow(text)
        assert (hashes.tolist(), positions.tolist()) == plain_winnow(text)


def test_a_long_shared_passage_is_found():
    rng = random.Random(1)
    passage = sentence(rng, 60)[: fingerprints.GRAM + fingerprints.WINDOW - 1]
    a, b = (fingerprints.winnow(sentence(rng, 80) + passage + sentence(rng, 50))[0] for _ in range(2))
    assert set(a.tolist()) & set(b.tolist())


def test_fingerprints_with_next(docs, texts, awkward, empty):
    found = {r["doc_id"]: r for r in fingerprints.fingerprints_with_next(docs).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(found, reverse=True) == order
    sets = {k: set(plain_winnow(t)[0]) if len(t) < 900 else set(fingerprints.winnow(t)[0].tolist()) for k, t in texts.items()}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    for doc_id, following in zip(order, order[1:] + order[:1]):
        r, text = found[doc_id], texts[doc_id]
        third = len(text) // 3
        edited = text[: len(text) - third] + texts[following][:third]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.written_form(*fingerprints.winnow(text))
        assert r["edited_fingerprint"] == fingerprints.written_form(*fingerprints.winnow(edited))
        assert r["near_edited"] == like(sets[doc_id], set(fingerprints.winnow(edited)[0].tolist()))
        assert r["near_next"] == like(sets[doc_id], sets[following])
    assert fingerprints.fingerprints_with_next(awkward).count() == 6
    assert fingerprints.fingerprints_with_next(empty).count() == 0
    one = fingerprints.fingerprints_with_next(docs.where("doc_id = 56")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprints(docs).count() == len(texts)


def test_short_texts_are_nearer_to_their_edited_form(spark):
    """From 22 code points on, the two thirds that an edit leaves hold a hash in common."""
    rng = random.Random(11)
    texts = {n: sentence(rng, 60)[:n] for n in range(22, 150)}
    rows = fingerprints.fingerprints_with_next(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["near_edited"] > max(0.05, 2 * r["near_next"]), r["n_chars"]


def test_fingerprints_across_blocks(spark):
    rows = spark.range(0, 5000, 1, 4).selectExpr("id * 3 as doc_id", "concat('text number ', id) as text")
    found = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints_with_next(rows).collect()}
    for k in (0, 1, 341, 342, 2500, 4999):
        text, following = f"text number {k}", f"text number {(k - 1) % 5000}"
        third = len(text) // 3
        assert found[3 * k] == hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()


# 2 Jaccard join


def shingles(text):
    words = WORDS.findall(text.translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def plain_components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k: (len(sets[k]), label[k]) for k in texts}


def test_jaccard_join(docs, texts, awkward, empty):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(docs).collect()}
    assert found == plain_components(texts)
    assert jaccard.linked_components(empty).count() == 0
    assert jaccard.linked_components(awkward).count() == 6
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, (_, c) in found.items() if c == k}


@pytest.mark.parametrize("mean_list", [0.0, 1000.0])
def test_both_ways_give_the_same_links(spark, monkeypatch, mean_list):
    """All sets by lists, or all up to 64 by subsets: small variations of a few texts."""
    rng = random.Random(9)
    texts = {}
    for k in range(120):
        words = [f"b{k % 4}w{j}" for j in range(6 + 7 * (k % 9))]
        for j in rng.sample(range(len(words)), rng.randint(0, 2)):
            words[j] = f"e{rng.randint(0, 3)}"
        texts[k] = " ".join(words)
    monkeypatch.setattr(jaccard, "token_classes", lambda signed, real=jaccard.token_classes: (real(signed)[0], mean_list))
    assert jaccard.boundary(mean_list) in (2, jaccard.MOST_SMALL)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(docs).collect()}
    assert found == plain_components(texts)


# 3 rules


def plain_rules(text):
    words = WORDS.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    return counts, len(words) < 50 or 100 * len(repeated) > 50 * len(words)


@pytest.mark.parametrize("few", [64, 0])
def test_rules(docs, texts, awkward, empty, monkeypatch, few):
    monkeypatch.setattr(rules, "FEW_REPEATS", few)
    rows = rules.quality_report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts, failed = plain_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*counts, failed)
        assert not (failed and r["kept"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    passed = rules.passed(docs)
    assert passed.columns == docs.columns and {r["doc_id"] for r in passed.collect()} == kept and kept
    assert rules.quality_report(awkward).count() == 6
    assert rules.quality_report(empty).count() == rules.passed(empty).count() == 0


def test_rules_run_without_python(docs):
    plan = rules.passed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# 4 personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_pii(text):
    return [(kind, *m.span()) for kind, (pattern, good) in BASE.items() for m in re.finditer(pattern, text) if good(m.group())]


def test_pii(docs, texts, empty, awkward):
    rng = random.Random(3)
    odd = ["".join(rng.choice("a1.@_%+- (5") for _ in range(40)) for _ in range(3000)]
    for text in [*texts.values(), *odd]:
        found = pii.find_spans(text)
        assert [s[:3] for s in found if s[0] in pii.BASE_KINDS] == plain_pii(text), text
    kinds = collections.Counter(s["kind"] for r in pii.find_pii(docs).collect() for s in r["spans"])
    assert kinds["iban"] == kinds["telephone"] == kinds["account"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, length_col=None).collect()}
    assert clean[0] is None and not any(plain_pii(t) for t in clean.values() if t and "<EMAIL>" not in t)
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0
    assert pii.find_pii(awkward).count() == 6


def test_pii_is_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@" * 1000, "+1" * 100_000, "1." * 100_000):
        pii.find_spans(text)


# 5 classifier


def test_classifier(spark, docs, empty, awkward):
    rng = random.Random(2)
    rows = [(k, sentence(rng, 60) if k % 3 else "JUNK!! " * 40 + sentence(rng, 5), int(k % 3 > 0)) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None), (1, 1)], "doc_id long, quality int"))
    weights = classifier.train(table, labels)
    scores = {r["doc_id"]: r["score"] for r in classifier.scored(table, weights).collect()}
    held = [k for k in scores if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((scores[k] >= classifier.THRESHOLD) == (k % 3 > 0) for k in held) and len(held) > 80
    assert classifier.kept_rows(table, weights).columns == table.columns
    assert classifier.kept_rows(table, weights).count() == sum(s >= classifier.THRESHOLD for s in scores.values())
    assert np.array_equal(weights, classifier.train(table.repartition(7), labels))
    bounded = classifier.train(table, labels, sample_rows=100)
    assert np.count_nonzero(bounded) and not np.array_equal(bounded, weights)
    nothing = classifier.train(table, labels.limit(0))
    assert not nothing.any() and classifier.scored(awkward, nothing).where("score = 0.5").count() == 6
    assert classifier.scored(docs, weights).where("score between 0 and 1").count() == len(TEXTS)
    assert classifier.scored(empty, weights).count() == 0


# 6 merge replay


def library(name):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(vocabulary(name)), special_tokens={})


def test_merge_replay(docs, texts, awkward, empty):
    tokens = library(MERGE_RANKS)
    pattern = public_tokenizers.PATTERN
    ids = bytebpe.encode(docs, vocabulary(MERGE_RANKS), pattern)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {k: tokens.encode_ordinary(t) for k, t in texts.items()}
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in bytebpe.decode(ids, vocabulary(MERGE_RANKS)).collect()} == texts
    for r in bytebpe.round_trip(docs, vocabulary(MERGE_RANKS), pattern).collect():
        own = tokens.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bytebpe.round_trip(awkward, vocabulary(MERGE_RANKS), pattern).count() == 6
    assert bytebpe.round_trip(empty, vocabulary(MERGE_RANKS), pattern).count() == 0


def test_merge_replay_on_random_text():
    rng = random.Random(4)
    texts = ["".join(rng.choice(" \n\t aab  .1é") for _ in range(30)) for _ in range(1500)] + ["".join(rng.choice("abehtsrn") for _ in range(60)) for _ in range(500)]
    encoder = bytebpe.SegmentEncoder(bytebpe.read_ranks(vocabulary(MERGE_RANKS)), public_tokenizers.PATTERN)
    made, tokens = encoder([t.encode() for t in texts]), library(MERGE_RANKS)
    for k, text in enumerate(texts):
        assert made.ids[made.offsets[k] : made.offsets[k + 1]].tolist() == tokens.encode_ordinary(text)


def test_a_merge_that_opens_a_lower_rank_is_redone():
    """abc has a lower rank than bc: after b+c the pair a+bc comes at once."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 257, b"cd": 258, b"aa": 259}
    merges = bytebpe.Merges(ranks)
    words = [b"abc", b"abcd", b"bcd", b"aaaa", b"aaa", b"xabcabcx"]
    made = merges.replay(words)
    assert [made.ids[a:b].tolist() for a, b in zip(made.offsets[:-1], made.offsets[1:])] == [merges.plain(w) for w in words]


# 7 token counts


def test_token_counts(docs, texts, awkward, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECE_MODEL))
    rows = tokencounts.token_counts(docs, vocabulary(PIECE_MODEL)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == {k: (len(t.encode()), len(model.encode(t))) for k, t in texts.items()}
    assert tokencounts.token_counts(awkward, vocabulary(PIECE_MODEL)).count() == 6
    assert tokencounts.token_counts(empty, vocabulary(PIECE_MODEL)).count() == 0
    whole = tokencounts.proven(vocabulary(PIECE_MODEL))
    assert len(whole) > 10_000 and all(len(model.encode(w[1:].decode())) == 1 for w in whole[::500])


# 8 class model


def test_class_model(docs, texts, awkward, empty):
    rows = {r["doc_id"]: r for r in classlm.scores(docs).collect()}
    tokens = {k: [*WORDS.findall(t.translate(LOWER)), None] for k, t in texts.items()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = collections.Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for k, ws in tokens.items():
        r = rows[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert classlm.scores(awkward).count() == 6
    assert classlm.scores(empty).count() == 0


def test_exchange_finds_the_classes():
    """Units alternate between two kinds; a few rounds tell them apart."""
    units, width = 40, classlm.CLASSES + 1
    class_of = np.append(np.arange(units) % 5, classlm.CLASSES)
    rng = np.random.default_rng(0)
    line = [int(rng.integers(units // 2) + (k % 2) * units // 2) for k in range(20000)]

    def counted(classes):
        after, before = np.zeros((units + 1, width)), np.zeros((units + 1, width))
        for a, b in zip(line, line[1:]):
            after[a, classes[b]] += 1
            before[b, classes[a]] += 1
        return after, before

    for _ in range(3):
        class_of = classlm.exchange(*counted(class_of), class_of)
    assert not set(class_of[: units // 2]) & set(class_of[units // 2 : units])


def test_every_repeated_word_is_clustered(spark, monkeypatch):
    """20,000 words that come three times have a unit each; pairs of units are counted whole; rounds end where nothing rises."""
    seen = {}
    counted, rounds = classlm.unit_pairs, classlm.clustered
    monkeypatch.setattr(classlm, "unit_pairs", lambda *a: seen.setdefault("heavy", a[2]) is None or seen.setdefault("pairs", counted(*a)))
    monkeypatch.setattr(classlm, "clustered", lambda *a: seen.setdefault("rounds", rounds(*a)))
    monkeypatch.setattr(classlm, "HEAVY", 50)
    rng = random.Random(8)
    words = [f"{'n' if k % 2 else 'v'}{k}" for k in range(20_000)]
    passes = [rng.sample(words, len(words)) for _ in range(3)]  # each has every word once
    texts = [" ".join(f"{rng.choice(['the', 'a']) if w[0] == 'n' else 'to'} {w}" for w in one[j::40]) for one in passes for j in range(40)] + [" ".join(words[:100]), "rare words"]
    model, _ = classlm.train_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert len(model.vocabulary.hashes) == 20_003 and model.end == classlm.classes_for(20_003 + classlm.GROUPS) > classlm.CLASSES
    units = lambda ws: model.vocabulary.units_of(classlm.word_hashes(*hashable(ws)), np.full(len(ws), -1))
    unit_of = dict(zip([*words, "the", "a", "to"], units([*words, "the", "a", "to"]).tolist()))
    assert sorted(unit_of.values()) == list(range(20_003))
    end, plain = model.vocabulary.units, collections.Counter()
    for text in texts[:-1]:
        line = [end, *(unit_of[w] for w in text.split()), end]
        plain.update(zip(line, line[1:]))
    found = collections.Counter()
    for r in seen["pairs"].collect():
        for a, b, n in classlm._unpacked(bytes(r["pairs"])).T.tolist():
            found[(a, b >> 1) if b % 2 == 0 else (b >> 1, a)] += n
    own = {k: n for k, n in found.items() if all(x < 20_003 or x == end for x in k)}
    own[end, end] = own.get((end, end), 0)
    # A pair is there for each of its units that is not heavy, or once; the first end of a slice may follow another one.
    heavy = set(seen["heavy"].tolist())
    times = {k: max(1, (k[0] not in heavy) + (k[1] not in heavy)) for k in plain}
    assert set(times.values()) == {1, 2}
    assert {k: times[k] * n for k, n in plain.items() if k[0] != end} == {k: n for k, n in own.items() if k[0] != end}
    classes, every = model.end, collections.Counter()
    for (a, b), n in found.items():
        every[a, b] += n // max(1, (a not in heavy) + (b not in heavy))
    class_of, bigrams = seen["rounds"][0], np.zeros((classes + 1, classes + 1))
    after, before = np.zeros((2, len(heavy), classes + 1))
    place = {u: i for i, u in enumerate(sorted(heavy))}
    for (a, b), n in every.items():
        bigrams[class_of[a], class_of[b]] += n
        if a in heavy:
            after[place[a], class_of[b]] += n
        if b in heavy:
            before[place[b], class_of[a]] += n
    for mine, theirs in zip((bigrams, after, before), classlm.class_counts(seen["pairs"], class_of, classes, seen["heavy"])):
        assert (mine == theirs).all()
    likelihoods = seen["rounds"][2]
    assert len(likelihoods) > 2 and all(b > a for a, b in itertools.pairwise(likelihoods[:-1]))
    nouns = collections.Counter(seen["rounds"][0][unit_of[w]] for w in words if w[0] == "n")
    verbs = collections.Counter(seen["rounds"][0][unit_of[w]] for w in words if w[0] == "v")
    assert sum(min(nouns[c], verbs[c]) for c in nouns) < 200


@pytest.mark.parametrize("sparse", [0, 8])
def test_best_classes_of_counted_and_sorted_pairs(monkeypatch, sparse):
    """Units with few and with many neighbouring classes get the class of a plain sum over their neighbours."""
    monkeypatch.setattr(classlm, "SPARSE", sparse)
    rng = np.random.default_rng(3)
    classes, units = 70, 400
    class_of = np.append(rng.integers(0, classes, units), classes)
    bigrams = rng.integers(0, 50, (classes + 1, classes + 1)).astype(float)
    pairs = {(int(u), int(o)): int(rng.integers(1, 5)) for u in range(units) for o in rng.integers(0, 2 * units + 2, 3 if u % 2 else 120)}
    unit, other, n = np.array([(u, o, k) for (u, o), k in sorted(pairs.items())]).T
    gains = classlm.Exchange(bigrams)
    score = np.zeros((units, classes))
    for (u, o), k in pairs.items():
        score[u] += k * gains.gains[(o & 1) * (classes + 1) + class_of[o >> 1]].astype(float)
    line, place, total = classlm._summed(unit, (other & 1) * (classes + 1) + class_of[other >> 1], n)
    score[np.arange(units), class_of[:-1]] = gains.stay(line, place, total, class_of[:-1])
    found, best = gains.best(unit, other, n, class_of)
    assert (found == np.arange(units)).all()
    assert np.allclose(score[found, best], score.max(1), rtol=1e-5)


def test_rows_of_pairs_are_compact():
    """Each round reads them: a unit is there once, a count takes a byte, and large counts come back whole."""
    rng = np.random.default_rng(4)
    unit = np.sort(rng.integers(0, 50, 4000))
    other, n = rng.integers(0, 2**31, 4000), rng.integers(1, 3, 4000)
    n[[0, 7, 8, 3999]] = 254, 255, 256, 2**32 - 1
    row = classlm._packed(unit, other, n)
    assert len(row) < 6 * len(unit)
    assert (classlm._unpacked(row) == np.stack((unit, other, n))).all()
    assert classlm._unpacked(classlm._packed(unit[:0], other[:0], n[:0])).shape == (3, 0)


@pytest.mark.parametrize("most", [3, 2**31])
def test_equal_pairs_are_summed(most):
    """Whether or not a count fits beside its pair in 64 bits."""
    rng = np.random.default_rng(5)
    unit, other, n = rng.integers(0, 30, 3000) * 10**6, rng.integers(0, 30, 3000) * 10**6, rng.integers(1, most, 3000)
    want = collections.Counter()
    for a, b, k in zip(unit.tolist(), other.tolist(), n.tolist()):
        want[a, b] += k
    found = np.stack(classlm._summed(unit, other, n)).T.tolist()
    assert [tuple(x[:2]) for x in found] == sorted(want) and {tuple(x[:2]): x[2] for x in found} == want


def test_words_are_counted_over_many_slices(spark, monkeypatch):
    """A task sends a word once for all slices that it counts together."""
    sent = []
    monkeypatch.setattr(classlm, "slices", lambda batches: slices(batches, 20))

    class Texts:
        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_pydict({"text": ["the cat the dog", None, "", "the cat The end", "the dog"] * 3})
            sent.extend(x for one in run([batch]) for x in one.to_pylist())
            return spark.createDataFrame(sent, "word long, group int, n long")

    found = classlm.word_counts(Texts()).collect()
    assert len(sent) == len(found) == 4 and sorted(r["n"] for r in found) == [3, 6, 6, 15]
    assert sorted(x["n"] for x in sent) == [3, 6, 6, 15]


def test_places_are_those_of_a_search():
    rng = np.random.default_rng(6)
    even = np.sort(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    near = np.arange(1000, 2000, dtype=np.uint64)  # all in one bucket
    for hashes in (even, near, even[:1]):
        words = rng.permutation(np.concatenate([hashes, hashes + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
        want = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        at, have = classlm.Places(hashes).of(words)
        assert (at == want).all() and (have == np.isin(words, hashes)).all()


def hashable(words):
    data = " ".join(words).encode()
    array = np.frombuffer(data, np.uint8)
    starts, ends, _ = classlm.word_bounds(array, np.array([0, len(data)]))
    return array, starts, ends


# 9 packing


def word_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(vocabulary(WORD_MODEL).decode())
    return {k: model.encode(t, add_special_tokens=False).ids for k, t in texts.items()}


def test_packing(docs, texts, awkward, empty):
    ids = word_ids(texts)
    rows = packing.pack(docs, vocabulary(WORD_MODEL).decode()).collect()
    sequences, covered = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = [*ids[r["doc_id"]], packing.END_ID]
        piece = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert (bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"], 4 * r["length"]) == (piece, zlib.crc32(piece), len(own), len(piece))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for spans in [*sequences.values(), *covered.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
    assert set(covered) == set(texts) and all(sum(n for _, n in s) <= packing.WINDOW for s in sequences.values())
    assert packing.pack(awkward, vocabulary(WORD_MODEL).decode()).count() == 6
    assert packing.pack(empty, vocabulary(WORD_MODEL).decode()).count() == 0


def plain_best_fit(lengths, window):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms[rooms.index(min(fit))] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


def test_runs_equal_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(200):
        window = rng.choice([10, 16, 37])
        lengths = [rng.randint(1, window - 1) for _ in range(rng.randint(0, 60))]
        runs, windows = packing.best_fit_decreasing(collections.Counter(lengths), window)
        used = collections.defaultdict(list)
        ranks = collections.defaultdict(list)
        for length, rank, n, first, offset in runs:
            ranks[length] += range(rank, rank + n)
            for k in range(n):
                used[first + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in collections.Counter(lengths).items()}
        for spans in used.values():
            assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(spans))) and min(spans)[0] == 0
        rooms = sorted(window - sum(n for _, n in s) for s in used.values())
        assert len(used) == windows and rooms == plain_best_fit(lengths, window)


# 10 id files


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, step in ((0, 1), (1, 1), (1, 10**9), (500, 1), (500, 3), (700, 5000), (300, 10**7)):
        values = np.cumsum(rng.integers(0, step, n)) if n else np.zeros(0, np.int64)
        packed = idfiles.EliasFano.of(values).to_bytes()
        read = idfiles.EliasFano.from_bytes(packed)
        assert read.all().tolist() == values.tolist() == [read[i] for i in range(n)] == read.at(np.arange(n)).tolist()
        some = rng.integers(0, max(n, 1), min(n, 50))
        assert read.at(some).tolist() == values[some].tolist() if n else True
    assert len(idfiles.EliasFano.of(np.cumsum(rng.integers(0, 5000, 10_000))).to_bytes()) < 10_000 * 16 / 8


def test_id_files(spark, docs, texts, awkward, empty, tmp_path):
    ids = word_ids(texts)
    at = 0
    rows = {r["doc_id"]: r for r in idfiles.through_files(docs, vocabulary(WORD_MODEL).decode()).collect()}
    assert len(rows) == len(texts)
    for k in sorted(texts):
        own = np.array([*ids[k], idfiles.END_ID], "<u4")
        assert (rows[k]["start"], rows[k]["n_tokens"], rows[k]["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
    assert idfiles.through_files(awkward, vocabulary(WORD_MODEL).decode()).count() == 6
    assert idfiles.through_files(empty, vocabulary(WORD_MODEL).decode()).count() == 0
    folder = str(tmp_path / "ids")
    idfiles.write_shards(docs, vocabulary(WORD_MODEL).decode(), folder)
    names = sorted(p for p in (tmp_path / "ids").iterdir() if p.name.endswith(".ids"))
    shard = idfiles.Shard(names[0].read_bytes())
    assert shard.document(1).tolist() == [*ids[shard.doc_ids()[1]], idfiles.END_ID]


def test_ranks_are_read_as_given():
    ranks = bytebpe.read_ranks(vocabulary(MERGE_RANKS))
    first = vocabulary(MERGE_RANKS).split(b"\n", 1)[0].split()
    assert ranks[base64.b64decode(first[0])] == int(first[1])


# identity of words, caches


def thue_morse(n):
    """Two words of 2^n letters whose hashes are equal in every polynomial with an odd base."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def alike(spark):
    """Texts that differ in one long word each, in both directions and with the words alone."""
    texts = [f"x {w} y" for n in (3, 6, 7, 8, 10, 12) for w in thue_morse(n)] + [w for n in (7, 10) for w in thue_morse(n)]
    return texts, spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)


def test_words_of_equal_patterns_stay_apart(spark, alike):
    import sentencepiece
    import tiktoken

    texts, docs = alike
    ranks = bytebpe.read_ranks(vocabulary(MERGE_RANKS))
    merges = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bytebpe.encode(docs, vocabulary(MERGE_RANKS), public_tokenizers.PATTERN).collect():
        assert r["ids"] == merges.encode_ordinary(texts[r["doc_id"]])
    model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary(PIECE_MODEL))
    for r in tokencounts.token_counts(docs, vocabulary(PIECE_MODEL)).collect():
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]]))
    ids = word_ids(dict(enumerate(texts)))
    for r in idfiles.through_files(docs, vocabulary(WORD_MODEL).decode()).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array([*ids[r["doc_id"]], idfiles.END_ID], "<u4").tobytes())
    for r in packing.pack(docs, vocabulary(WORD_MODEL).decode()).collect():
        own = [*ids[r["doc_id"]], packing.END_ID]
        assert bytes(r["ids"]) == np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
    assert all(r["component_id"] == r["doc_id"] for r in jaccard.linked_components(docs).collect())


@pytest.mark.parametrize("most", [100, 3000, 20_000])
def test_tokens_do_not_depend_on_the_cache(monkeypatch, most):
    """A store that is full after every slice, and one whose segments all have one hash."""
    import pyarrow as pa

    from barspan.llm import segments, text, wordbpe

    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(0, 60)) for _ in range(150)] + ["It's, THE. the, The... É é,", "1,234.5 a.b,c", ",,,", "." * 300, "ÀÉ÷×ß.,"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    want = word_ids(dict(enumerate(texts)))

    def found():
        out = []
        for _, ids, offsets in wordbpe.encoded([batch], vocabulary(WORD_MODEL).decode()):
            out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
        return out

    monkeypatch.setattr(segments, "MOST_BYTES", most)
    monkeypatch.setattr(text, "SLICE_BYTES", 500)
    monkeypatch.setattr(wordbpe, "slices", lambda batches: text.slices(batches, 500))
    wordbpe._stores.clear()
    assert found() == [want[k] for k in range(len(texts))]
    monkeypatch.setattr(segments, "word_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    wordbpe._stores.clear()
    assert found() == [want[k] for k in range(len(texts))]
    wordbpe._stores.clear()


def test_repeated_ids_keep_their_links(spark):
    """An id whose one text is a copy and whose other text has a near copy links to both."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    near = b.replace("b59", "other")
    rows = [(1, a), (5, a), (5, b), (9, near), (20, "nothing like the others at all here"), (None, a), (None, None), (30, None), (30, "")]
    found = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=str)
    want = [(1, 56, 1), (5, 56, 1), (5, 56, 1), (9, 56, 1), (20, 3, 20), (None, 56, None), (None, 0, None), (30, 0, 30), (30, 0, 30)]
    assert got == sorted(want, key=str)
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, -1, 1, 20, 30, 30]


def test_repeated_and_missing_ids_have_their_own_results(spark, awkward):
    """Values, not numbers of rows, of rows without id and of rows that repeat one."""
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    ids = word_ids({k: t for k, (_, t) in enumerate(rows)})
    by_text = {t: ids[k] for k, (_, t) in enumerate(rows)}
    crc = lambda t, end: zlib.crc32(np.array([*by_text[t], end], "<u4").tobytes())
    key = lambda r: str(r)
    files = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in idfiles.through_files(awkward, vocabulary(WORD_MODEL).decode()).collect()]
    assert sorted(files, key=key) == sorted(((d, len(by_text[t]) + 1, crc(t, idfiles.END_ID)) for d, t in rows), key=key)
    packed = [(r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.pack(awkward, vocabulary(WORD_MODEL).decode()).collect()]
    assert sorted(packed, key=key) == sorted(((d, len(by_text[t]) + 1, crc(t, packing.END_ID)) for d, t in rows), key=key)
    report = [(r["doc_id"], r["n_words"]) for r in rules.quality_report(awkward).collect()]
    assert sorted(report, key=key) == sorted(((d, len(WORDS.findall(t))) for d, t in rows), key=key)
    counted = [(r["doc_id"], r["n_bytes"]) for r in tokencounts.token_counts(awkward, vocabulary(PIECE_MODEL)).collect()]
    assert sorted(counted, key=key) == sorted(((d, len(t.encode())) for d, t in rows), key=key)
