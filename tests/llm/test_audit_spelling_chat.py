"""The filter audit, the spelling variants and the chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fibrespark.llm import op11_filter_audit, op12_spelling, op13_chat

# 11 --------------------------------------------------------------------------------------------------------------


def audit_documents():
    rnd = random.Random(3)
    text = lambda n, k: " ".join(rnd.choice([f"w{i}" for i in range(k)]) for _ in range(n))
    rows = [(k, text(rnd.randint(20, 90), rnd.choice([9, 400])) + rnd.choice(["", " LOUD SHOUTING TEXT", " #tag"]), f"s{k % 3}") for k in range(60)]
    hot = text(70, 500)
    rows += [(100 + k, hot, rnd.choice(["s0", "s1", None])) for k in range(40)]
    rows += [(60, hot, "s2"), (60, hot, "s2"), (60, hot, None), (None, hot, "s1"), (None, "only here twice", "s1"), (None, "only here twice", "s1")]
    rows += [(200, None, "s0"), (201, "", "s0"), (202, "", None), (203, "w " * 30000, "long"), (204, "é" * 9 + "A", "long")]
    return rows


def audit_wanted(rows, labels):
    masks = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        key = lambda x: 2**63 - 1 if x is None else x
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": any(key(j) < key(i) and (u or "") == t for j, u, _ in rows),
        }
        marks = [x for x in labels if i is not None and x[0] == i]
        masks.append((source or "", {c for c in fails if fails[c]}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(own), []
            for step, c in enumerate(order, 1):
                hit = [m for m in left if c in m[1]]
                shapley[c] += len(hit)
                out[part, "".join(order), step] = [
                    len(left) - len(hit), len(hit), sum(c in m[1] for m in gone), sum(m[1] == {c} for m in own), sum(m[2] for m in hit), sum(m[3] for m in hit), c,
                ]
                left, gone = [m for m in left if c not in m[1]], gone + hit
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return out


def test_audit_of_orders(spark):
    rows = audit_documents()
    rnd = random.Random(4)
    labels = [(k, rnd.randint(0, 1), rnd.randint(0, 1)) for k in range(0, 140, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (9999, 1, 1), (102, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, mask int, part int").repartition(3)
    got = op11_filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit_wanted(rows, labels)
    assert len(got) == len(want) == 120 * 5 * len({r[2] for r in rows})
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_audit_without_documents_or_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert op11_filter_audit.audit(docs).count() == 0
    one = spark.createDataFrame([(1, "few words", "s")], "doc_id long, text string, source string")
    assert all(r.good_lost == r.toxic_lost == 0 for r in op11_filter_audit.audit(one).collect())


def test_audit_of_other_filters(spark):
    docs = spark.createDataFrame([(1, "ab", "s"), (2, "a", "s"), (3, "a", "s")], "doc_id long, text string, source string")
    got = op11_filter_audit.audit(docs, letters="XE", conditions=lambda text: [text.contains("b")]).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed) for r in got) == [("EX", 1, 2, 1), ("EX", 2, 1, 1), ("XE", 1, 2, 1), ("XE", 2, 1, 1)]


# 12 --------------------------------------------------------------------------------------------------------------


def at_distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_wanted(counts, ratio):
    near = {w: sorted((v for v in counts if at_distance_one(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: near[w][0] if near[w] and counts[near[w][0]] >= ratio * counts[w] else None for w in counts}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@pytest.mark.parametrize("crowded", [2, 4096])
def test_variants(spark, crowded):
    rnd = random.Random(crowded)
    words = {"".join(rnd.choice("aaé") for _ in range(rnd.randint(1, 9))) for _ in range(250)} | {"aaaaaaaa" + x for x in "bcdefghij"} | {"x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499}
    counts = {w: int(5 ** rnd.uniform(0, 5)) for w in words}
    got = op12_spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), ratio=2, crowded=crowded).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == variants_wanted(counts, 2)
    assert len(got) == len(counts)


def test_each_link_is_found_once(spark):
    words = ["aaaa", "aaa", "aaaaa", "aaba", "abaa", "baaa", "aab", "ab", "a", "b", ""]
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for crowded in (1, 100):
        got = Counter((r.word, r.near) for r in op12_spelling.near_words(frame, least_chars=0, crowded=crowded).collect())
        assert got == Counter((a, b) for a in words for b in words if at_distance_one(a, b))


def test_a_letter_in_all_places_lists_each_word_once_per_half(spark):
    """Words that differ in one place only: what is sent and joined grows with the words."""
    words = [(f"{a}{b}cdefgh", 1) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    links = op12_spelling.near_words(spark.createDataFrame(words, "word string, n long"), crowded=50)
    assert links.count() == 676 * 50


def test_vocabulary_and_empty_tables(spark):
    rnd = random.Random(1)
    texts = [(k, " ".join(rnd.choice(["Étudiant", "STRASSE", "straße", "kleine", "kurz", "ÀÉÎÕÜÿ", "a×b÷cd", "don't", "Maßstab"]) for _ in range(60)) + ", " + "Z" * 40) for k in range(300)]
    texts += [(None, "kleine kleine"), (None, None), (3, ""), (5, "kleine"), (5, "kleine")]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += len(w) >= 6
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, word string").repartition(3)
    got = {r.word: r.n for r in op12_spelling.vocabulary(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 5} and len(got) > 8
    full = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op12_spelling.spelling_variants(docs).collect()}
    assert full == variants_wanted(got, 5) and any(v[0] for v in full.values())
    assert op12_spelling.spelling_variants(docs.limit(0)).count() == 0


# 13 --------------------------------------------------------------------------------------------------------------

pieces = st.lists(st.sampled_from([*op13_chat.CHAT.controls, "<", "[", "\\", "|im_start|>", "s>", "/INST]", "\n", "é", "assistant", " "]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(pieces, st.just("assistant")), pieces), max_size=5))
@settings(max_examples=400, deadline=None)
def test_template_is_reversible(turns):
    text, spans = op13_chat.CHAT.render(turns)
    assert op13_chat.CHAT.read(text) == turns
    assert [op13_chat.CHAT.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>"):
        assert control not in text


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        op13_chat.Template(controls=("<a<b>", "<b>"))


MESSAGES = "tree string, id long, parent long, role string, text string, score double, node int, path int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], MESSAGES).repartition(3)


def test_paths_of_trees(spark):
    rnd = random.Random(2)
    rows = []
    for tree in ("t0", "t1", "t2", None):
        for k in range(60):
            rows.append((tree, k, rnd.randrange(k) if k else None, rnd.choice(["user", "assistant"]), f"{tree}-{k}", float(rnd.randint(-3, 3))))
    rows += [("chain", k, k - 1, "user", str(k), None) for k in range(100)]
    want = defaultdict(list)
    for tree in ("t0", "t1", "t2", None, "chain"):
        own = {r[1]: r for r in rows if r[0] == tree}
        for leaf in set(own) - {r[2] for r in own.values()}:
            line = [own[leaf]]
            while line[-1][2] in own:
                line.append(own[line[-1][2]])
            want[tree].append((-sum(r[5] or 0 for r in line), -len(line), leaf, [(r[3], r[4]) for r in reversed(line)]))
        want[tree].sort()
    for branches in (1, 3, None):
        got = defaultdict(list)
        for r in op13_chat.paths(messages(spark, rows), branches).collect():
            got[r.tree].append((r.branch, -r.score, r.leaf, [tuple(t) for t in r.turns]))
        assert {t: sorted(x) for t, x in got.items()} == {t: [(k, s, leaf, line) for k, (s, _, leaf, line) in enumerate(x[:branches], 1)] for t, x in want.items()}


def test_odd_trees(spark):
    rows = [
        ("circle", 1, 2, "user", "a", 1.0), ("circle", 2, 1, "user", "b", 1.0), ("circle", 3, 1, "user", "c", 1.0), ("circle", 4, None, "user", "root", 0.0),
        ("orphan", 5, 99, None, None, None), ("orphan", 6, 5, "assistant", "x", None), ("noid", None, None, "user", "y", 1.0), ("noid", None, 7, "user", "z", 1.0),
        ("twice", 1, None, "user", "second", 0.0), ("twice", 1, None, "user", "first", 0.0), ("twice", 2, 1, "assistant", "reply", 1.0), ("self", 1, 1, "user", "me", 1.0),
    ]
    got = {(r.tree, r.branch): [tuple(t) for t in r.turns] for r in op13_chat.paths(messages(spark, rows), None).collect()}
    noid = [v for k, v in got.items() if k[0] == "noid"]
    assert sorted(noid) == [[("user", "y")], [("user", "z")]]
    assert {k: v for k, v in got.items() if k[0] != "noid"} == {
        ("circle", 1): [("user", "root")], ("orphan", 1): [("", ""), ("assistant", "x")], ("twice", 1): [("user", "first"), ("assistant", "reply")], ("twice", 2): [("user", "second")],
    }
    assert op13_chat.paths(messages(spark, [])).count() == 0


def test_conversations_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 1, "assistant", "b"), (1, 0, None, None), (1, None, "assistant", "é" * 50_000), (1, 1, "assistant", "a"), (None, 0, "user", "<|im_end|>"), (2, 5, "assistant", None)]
    rows += [(9, k, ("user", "assistant")[k % 2], f"turn {k} <s>") for k in range(300)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, id int").repartition(4)
    got = {r.conv_id: r for r in op13_chat.chat_report(frame).collect()}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((2**63 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(convs)
    for c, own in convs.items():
        own.sort()
        learnt = "".join(t for _, r, t in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(own), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got[-1].formatted_chars == 2 * (12 + 1 + 11) + len("userassistant") + 2 * (len(said) + 3)
    assert op13_chat.chat_report(frame.limit(0)).count() == 0
