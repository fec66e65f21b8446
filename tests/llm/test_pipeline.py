"""The pipeline's stages on their own written inputs, each held against what its operator's rule says."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(k, n=90):
    rnd = random.Random(k)
    return "\n".join(" ".join(f"w{rnd.randrange(10**6)}" for _ in range(15)) for _ in range(n // 15))


def test_run(spark, tmp_path):
    shared = "one and the same line that many of the documents hold among their own"
    rows = [(k, clean(k) + "\n" + shared, "en", f"s{k % 3}") for k in range(30)]
    rows += [(100, "too short", "en", "s0"), (101, None, "en", "s0"), (102, clean(3) + "\n" + shared, "en", "s1"), (103, clean(600) + "\nand " + clean(500, 15), "en", None)]
    (tmp_path / "sf").mkdir()
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        if name != "encoding":
            assert docs.columns == COLUMNS
    quality, lines, near, mixing, encoding = seen
    assert {r.doc_id for r in quality} == {*range(30), 102, 103}
    by_id = {r.doc_id: r for r in lines}
    assert 102 not in by_id and by_id[0].text == rows[0][1] and by_id[5].text == clean(5) and by_id[5].n_chars == len(clean(5))
    assert {r.doc_id for r in near} == set(by_id)
    text = {r.doc_id: r.text for r in near}
    assert all(r.text == text[r.doc_id] for r in mixing)
    words = sum(len(t.split()) for t in text.values())
    taken = sum(len(r.text.split()) for r in mixing)
    assert abs(taken - 1.5 * words) <= 4 * max(len(t.split()) for t in text.values())
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted((r.doc_id, r.ids) for r in encoding) == sorted((r.doc_id, model.encode(r.text)) for r in mixing)


def test_run_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# the whole run against brute force -------------------------------------------------------------------------------


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def quality_kept(rows):
    measured = []
    for _, text, lang, source in rows:
        w, t = words(text), text or ""
        lines = [x for x in t.split("\n") if words(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        ratios = [sum(map(len, w)) / max(1, len(w)), len(re.findall(r"[#*$%&|<>]", t)) / max(1, len(w)), (len(lines) - len(set(lines))) / max(1, len(lines)), len(covered) / max(1, len(w))]
        measured.append((lang, source, len(w) < 50 or 100 * len(covered) > 50 * len(w), ratios))
    kept = []
    for row, (lang, source, failed, ratios) in zip(rows, measured):
        groups = [[m for m in measured if not m[2] and (m[0], m[1]) == (lang, source)], [m for m in measured if not m[2] and m[0] == lang], [m for m in measured if not m[2]]]
        group = next((g for g in groups[:2] if len(g) >= 200), groups[2])
        good = not failed
        for k, least in enumerate((0.5, 0.03, 0.1, 0.1)):
            v = sorted(m[3][k] for m in group)
            q25, q75 = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.75)) if v else (0, 0)
            reach = 3 * max(q75 - q25, least)
            good &= ratios[k] <= q75 + reach and (k > 0 or ratios[k] >= q25 - reach)
        if good:
            kept.append(row)
    return kept


def within(a, b, edits=2):
    """Whether bytes a and b are at most ``edits`` edits apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    return edits > 0 and any(within(x, y, edits - 1) for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])))


def classes(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def lines_cut(rows):
    found = [(i, k, line) for i, t, *_ in sorted(rows) for k, line in enumerate((t or "").split("\n")) if words(line)]
    lines = list(dict.fromkeys(line for *_, line in found))
    raw = [x.encode() for x in lines]
    root = classes(len(lines), [(a, b) for a in range(len(lines)) for b in range(a) if min(len(raw[a]), len(raw[b])) >= 24 and within(raw[a], raw[b])])
    number, seen, gone = {x: k for k, x in enumerate(lines)}, set(), set()
    for i, k, line in found:
        c = root[number[line]]
        if c in seen:
            gone.add((i, k))
        seen.add(c)
    out = []
    for i, t, lang, source in rows:
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone)
        if words(left):
            out.append((i, left, lang, source))
    return out


def one_of_each(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = classes(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return [row for k, row in enumerate(rows) if row[0] == least[root[k]]]


def mix_of(rows):
    sizes = Counter()
    for _, t, _, source in rows:
        sizes[source] += len(words(t))
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_sources, want = {}, set(sources), 1.5 * sum(sizes.values())
    while open_sources:
        level = (want - sum(target.values())) / sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if level * weight[s] > 2 * sizes[s]]
        for s in over or open_sources:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        open_sources -= set(over) or open_sources
    out = []
    for s in sources:
        whole = int(target[s] // sizes[s])
        left, upto = target[s] - whole * sizes[s], 0
        for h, row in sorted((int(hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest()[:15], 16), r) for r in rows if r[3] == s):
            below, upto = upto, upto + len(words(row[1]))
            out += [row] * (whole + (upto <= left or (below <= left and upto - left < left - below)))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    rows = []
    for k in range(40):
        text = clean(k, 90 + 15 * (k % 4))
        rows.append((k, text, "en" if k % 5 else "de", (None, "a", "b", "c")[k % 4]))
        if k % 4 == 0:  # the same words, or nearly so, in other lines: a near copy none of whose lines is one
            w = text.split()
            w[rnd.randrange(len(w))] = "changed"
            rows.append((100 + k, "\n".join(" ".join(w[j : j + 13]) for j in range(0, len(w), 13)), "en", "b"))
        if k % 6 == 1:  # lines that another has, one of them with two letters changed
            shared = text.split("\n")[0]
            rows.append((200 + k, clean(500 + k, 75) + "\n" + shared[:9] + "zz" + shared[11:] + "\n" + text.split("\n")[1], "en", "c"))
    rows += [(300, "too short", "en", "a"), (301, None, "en", "a"), (302, rows[0][1], "en", None), (303, "a b c " * 40, "de", "b"), (304, " ".join(f"{w}###$$$" for w in clean(7).split()), "en", "a")]
    frame = spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = quality_kept(rows)
    cut = lines_cut(kept)
    alone = one_of_each(cut)
    mixed = mix_of(alone)
    assert len(kept) < len(rows) and [r[1] for r in cut] != [r[1] for r in kept] and len(cut) < len(kept) and len(alone) < len(cut) and len(mixed) != len(alone)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, text, *_ in mixed:
        ids = model.encode(text)
        want.append((i, len(ids), ids, hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in got.collect()) == sorted(want)
