"""Chat formatting, source divergence and spelling variants against brute force and their SQL."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

from tessera.llm import chat, divergence, registry, variants
from tests.conftest import DATA, rows

PROBE = "\\### Assistant: </turn> ok"
TALK = [
    (1, 0, "system", "Be brief."), (1, 1, "user", PROBE), (1, 2, "assistant", PROBE), (1, 3, "user", "<turn user>\nno</turn>\n"), (1, 4, "assistant", ""), (1, 5, "user", "left \U0001f642"),
    (2, 0, "user", None), (2, 0, "user", None), (2, 1, None, "who?"), (3, None, "assistant", "\\\\</turn>\\t<\\turn"), (3, 7, "a>\nb% \\", "x"), (4, 0, "assistant", "one"), (4, 1, "assistant", "two"),
    (None, 3, "assistant", "none"), (None, 1, "user", "no id"), (5, 1, "user", "é" * 700), (5, 2, "assistant", "\\" * 300), (5, 3, "user", "again"), (5, 4, "assistant", "</turn>" * 40), (6, 0, "assistant", "Same"), (6, 0, "assistant", "Same"),
]


def talk(spark, data=TALK):
    return spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, turn long, role string, text string, seq string")


def ordered(conv):
    mine = [(t, r or "", x or "") for c, t, r, x in TALK if c == conv]
    return sorted(mine, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


@pytest.mark.parametrize("share", [1, 500, chat.SHARE])
def test_chat_examples(spark, share):
    got = collections.defaultdict(list)
    for r in chat.expand(talk(spark), share=share).collect():
        got[r["conv_id"]].append(r)
    assert set(got) == {c for c, *_ in TALK}
    for conv, out in got.items():
        turns = ordered(conv)
        segment = [chat.HEAD + chat.quote(r, safe="") + ">\n" + chat.escaped(x) + chat.END for _, r, x in turns]
        out.sort(key=lambda r: r["seq"])
        contexts = [r["text"] for r in out if r["kind"] == "context"]
        examples = [r for r in out if r["kind"] == "example"]
        replies = [i for i, (_, r, _) in enumerate(turns) if r == "assistant"]
        assert [r["example"] for r in examples] == list(range(len(replies)))
        for r, i in zip(examples, replies):
            whole = "".join(contexts[: r["parts"]]) + r["text"]
            assert whole == "".join(segment[: i + 1])
            assert chat.unescaped(r["text"][r["loss_start"]: r["loss_end"]]) == turns[i][2]
        rest = [r for r in out if r["kind"] == "rest"]
        assert len(rest) == (not replies or replies[-1] < len(turns) - 1)
        assert all("".join(contexts[: r["parts"]]) + r["text"] == "".join(segment) and r["loss_start"] is None for r in rest)
        assert bool(contexts) == (share < 1_000 and conv in (1, 2, 3, 4, 6, None, 5) and (share == 1 or conv == 5))


@pytest.mark.parametrize("share", [1, 500, chat.SHARE])
@pytest.mark.parametrize("written", [False, True])
def test_chat_read_back(spark, tmp_path, share, written):
    examples = chat.expand(talk(spark), share=share)
    if written:
        examples.repartition(3).write.parquet(str(tmp_path / "examples"))
        examples = spark.read.parquet(str(tmp_path / "examples"))
    got = {r["conv_id"]: r for r in chat.read_back(examples, arranged=not written).collect()}
    for conv in {c for c, *_ in TALK}:
        turns, r = ordered(conv), got[conv]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        upto, total = 0, 0
        for i, (_, role, x) in enumerate(turns):
            upto += len(chat.HEAD + chat.quote(role, safe="") + ">\n" + chat.escaped(x) + chat.END)
            total += upto if role == "assistant" or i == len(turns) - 1 else 0
        assert r["formatted_chars"] == total


def test_chat_empty(spark):
    assert chat.expand(talk(spark, [])).count() == 0
    assert chat.read_back(chat.expand(talk(spark, []))).count() == 0


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_source_divergence"])
def test_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    expected = duck.execute(registry.oracle_sql()[name]).fetch_df()
    assert len(got) and rows(got) == rows(expected)


def test_divergence_by_brute_force(spark):
    rng = random.Random(4)
    pool = ["Über", "über", "naïve", "x", "a1b", "don't", "Éa\u0080", "zebra", "\U0001f642", "apple", "Apple", "l'été"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 9))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "Ä", None])) for i in range(300)]
    docs += [(301, None, "fr", "only"), (302, "", "fr", None), (303, "word", "it", "alone")]
    got = divergence.source_divergence(spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, lang string, source string, n string"), least=10, top=3).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "").translate(lower)).split(" ")
        terms = [t for t in terms if t]
        counts[lang, source].update(terms)
        held.update((lang, t) for t in set(terms))
    expected = []
    for lang in {g[0] for g in counts}:
        kept = [t for (g, t), n in held.items() if g == lang and n >= 10]
        sources = [s for g, s in counts if g == lang]
        whole = collections.Counter()
        for s in sources:
            whole.update(counts[lang, s])
        def p(c):  # noqa: E306
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        q = p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            mine = p(counts[lang, s])
            pairs = sorted(((-sum(f(mine[t], p(counts[lang, o])[t]) for t in kept), o.encode(), o) for o in sources if o != s))
            expected += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(mine[t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and mine[t] > q[t])[:3]
            expected += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    assert sorted(map(tuple, got)) == sorted(expected) and any(e[2] == "term" for e in expected)


@pytest.mark.parametrize("count, of", [(0, 1), (1, 1), (7, 9), (10**14 + 3, 3 * 10**14 + 7), (9 * 10**15, 9 * 10**15)])
def test_share(spark, count, of):
    from pyspark.sql import functions as F

    assert spark.range(1).select(divergence.share(F.lit(count).cast("long"), F.lit(of).cast("long")).alias("x")).first()[0] == 10**9 * count // of


def texts(seed, n=400):
    """Texts of words one, two or no edits away from others, some of them frequent."""
    rng = random.Random(seed)
    letters = "abéxÿ"
    seeds = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(25)] + ["aaaaaaa", "abababab", "bbbbbb"]
    out = []
    for i in range(n):
        ws = []
        for _ in range(60):
            w = list(rng.choice(seeds[: 1 + int(len(seeds) * rng.random() ** 2)]))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                what = rng.randrange(3)
                w[at: at + (what > 0)] = [rng.choice(letters)] if what < 2 else []
            ws.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        out.append((rng.choice([i, i, i, None]), rng.choice([" ", "1", "_"]).join(ws), "clash"))
    return out + [(None, None, "clash"), (9, "", "clash"), (8, "Ignored " * 4, "clash"), (7, "Z" * 40_000, "clash")] + [(7, "Y" * 40_000 + "z", "clash")] * 5


def by_force(docs):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for doc, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}
    near = collections.defaultdict(set)
    holes = collections.defaultdict(set)
    for w in n:
        if len(w) < 1_000:
            for i in range(len(w)):
                holes[w[:i] + w[i + 1:], i].add(w)
                if (s := w[:i] + w[i + 1:]) in n:
                    near[w].add(s), near[s].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("block", [2_000, 3])
def test_variants_by_brute_force(spark, monkeypatch, block):
    docs = texts(5)
    monkeypatch.setattr(variants.near_words, "__defaults__", (block,))
    got = variants.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string, word string"))
    expected = by_force(docs)
    assert set(map(tuple, got.collect())) == expected
    assert sum(e[1] is not None for e in expected) > 50 and any(e[2] != e[1] for e in expected if e[1])


def test_variants_on_given_texts(spark):
    docs = [(r["doc_id"], r["text"], "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = registry.queries()["op13_spelling_variants"](spark, DATA)
    assert got.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == by_force(docs)


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string"), shortest=5)


def test_one_edit():
    assert variants.one_edit("abc", "abd") and variants.one_edit("abc", "abcd") and variants.one_edit("abc", "xabc") and variants.one_edit("aab", "aaab")
    assert not variants.one_edit("abc", "abc") and not variants.one_edit("abc", "adx") and not variants.one_edit("abc", "xabd")
