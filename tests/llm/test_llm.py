import random

import pytest

from pedlake.llm import mixing, spam, splits, tokenizer

S = "sample_id long, fid string, iid string, pat string, mat string, unit string"
DOC = "doc_id long, text string, source string, rate double"


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer.VOCABULARY, "rb") as f:
        return tokenizer.Encoder(f.read())


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice("aAbZ 12\n\t.é漢👩'st <|endoftext|>") for _ in range(rng.randrange(200))) for _ in range(n)] + ["", " ", "a" * 3000, " " * 2000, "漢" * 500, "<|endoftext|>"]


def test_ids_are_the_library_s(encoder, library):
    assert all(encoder.encode(t) == library.encode_ordinary(t) for t in texts(1500))


def test_every_token_is_its_own_encoding(encoder):
    v = encoder.vocabulary
    assert all(tokenizer.Prefixes(v, t).tokens() == [t] for t in random.Random(1).sample(sorted(v.ranks), 3000))


def test_append_and_edit(encoder):
    v, rng = encoder.vocabulary, random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"abcde ingthe") for _ in range(rng.randrange(1, 900)))
        p = tokenizer.Prefixes(v, data[: len(data) // 2])
        p.append(data[len(data) // 2 :])
        assert p.last == tokenizer.Prefixes(v, data).last and b"".join(p.tokens()) == data
        a = rng.randrange(len(data))
        b, new = min(len(data), a + rng.randrange(6)), bytes(rng.choice(b"abc ") for _ in range(rng.randrange(5)))
        p.edit(a, b, new)
        assert p.data == data[:a] + new + data[b:] and p.last == tokenizer.Prefixes(v, p.data).last
    long = tokenizer.Prefixes(v, b"the cat " * 2000)
    assert long.edit(10, 11, b"z") < 1000


def test_encode_rows(spark, library):
    rows = [(i, t, "s", 0.0) for i, t in enumerate(texts(50))] + [(1000, None, None, None)]
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t, *_ in rows}
    n = {r["doc_id"]: r["n_tokens"] for r in tokenizer.count_tokens(spark.createDataFrame(rows, DOC)).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert tokenizer.encode(spark.createDataFrame([], DOC)).count() == 0


def test_tied_families(spark):
    rows = [(1, "a", "x", None, None, ""), (2, "B ", "y", "X", "0", ""), (3, "c", "z", None, "y", ""), (4, "d", "q", "0", None, ""), (5, None, "q2", "q", None, ""), (6, "e", None, None, None, ""), (7, "f", "0", None, None, "")]
    df = spark.createDataFrame(rows, S)
    assert sorted(map(tuple, splits.tied_pairs(df).collect())) == [("A", "B"), ("A", "C"), ("B", "C")]
    assert splits.tied_pairs(df.limit(0)).count() == 0


def test_splits_hold_families_together(spark):
    rng = random.Random(9)
    rows = [(i, f"F{rng.randrange(700)}" if i % 10 else "HUGE", f"I{rng.randrange(9000)}", None, None, "") for i in range(4000)] + [(5000, None, None, None, None, "")]
    targets = spark.createDataFrame([("train", 0.8, 1), ("test", 0.1, 2), ("val", 0.1, 3)], "split_name string, target_share double, n_rows int")
    df = spark.createDataFrame(rows + rows[:5], S)
    got = splits.assign(df, targets).collect()
    assert len(got) == 4001
    fam, person, where = {}, {}, {r["sample_id"]: r["split_name"] for r in got}
    for i, f, p, *_ in rows:
        fam.setdefault(f, set()).add(where[i])
        person.setdefault(p, set()).add(where[i])
    assert all(len(s) == 1 for k, s in [*fam.items(), *person.items()] if k)
    assert where == {r["sample_id"]: r["split_name"] for r in splits.assign(df, targets).collect()}
    for few in ((df.limit(0), targets), (df, targets.limit(0))):
        assert splits.assign(*few).count() == 0


def test_split_shares(spark):
    rows = [(i, f"F{i // 4}", f"I{i}", None, None, "") for i in range(6000)]
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("val", 0.1)], "split_name string, target_share double")
    got = {r["split_name"]: r for r in splits.shares(spark.createDataFrame(rows, S), targets).collect()}
    assert all(abs(r["share"] - r["target_share"]) < 0.005 for r in got.values()) and sum(r["n_components"] for r in got.values()) == 1500


def test_mixture(spark):
    rng = random.Random(3)
    words = lambda: " ".join(rng.choice(["gene", "marker", "family"]) for _ in range(rng.randrange(5, 60)))
    rows = [(i, words(), "big" if i < 700 else "mid" if i < 900 else "tiny" if i < 950 else None, 1.0) for i in range(1000)] + [(2000, None, "big", 1.0), (2001, "", "mid", 1.0), (2002, "a b", "other", 1.0)]
    targets = [("big", 0.5, 1, 0.0), ("mid", 0.3, 2, 0.0), ("tiny", 0.2, 3, 0.0), ("absent", 0.1, 3, 0.0), ("null", None, None, 0.0)]
    df, t = spark.createDataFrame(rows, DOC), spark.createDataFrame(targets + targets[:1], "source string, target_share double, max_repeats int, tokens double")
    got = mixing.mixture(df, t.drop("tokens")).collect()
    caps, have = {s: m for s, _, m, _ in targets}, {}
    for r in got:
        assert 1 <= r["copies"] <= caps[r["source"]]
        have[r["source"]] = have.get(r["source"], 0) + r["copies"] * r["n_tokens"]
    total = sum(have.values())
    assert all(abs(have[s] / total - share) < 0.01 for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    assert len(got) == len({r["doc_id"] for r in got})
    share = {r["source"]: r["share"] for r in mixing.shares(df, t.drop("tokens")).collect()}
    assert share["absent"] == 0 and abs(sum(share.values()) - 1) < 1e-9
    half = mixing.mixture(df, t.drop("tokens"), total_tokens=total / 2).collect()
    assert abs(sum(r["copies"] * r["n_tokens"] for r in half) / (total / 2) - 1) < 0.02
    assert mixing.mixture(df.limit(0), t).count() == 0


def test_newton_with_log_weights(spark):
    import math

    rng = random.Random(4)
    rows = [(x, rng.choice([-2.0, 0.0, 1.5]), rng.randrange(1, 3000), rng.randrange(1, 9)) for x in "abcd" for _ in range(60)]
    sums = spark.createDataFrame(rows, "source string, b double, tokens long, n long")
    caps, whole = {"a": 1.0, "b": 4.0, "c": 2.0, "d": 3.0}, {x: sum(t * n for y, _, t, n in rows if y == x) for x in "abcd"}
    budgets = {"a": 0.6 * whole["a"], "b": 3.9 * whole["b"], "c": 1e-7 * whole["c"], "d": 3.0 * whole["d"]}
    m = mixing.solve(sums, budgets, caps)
    value = lambda s, x: sum(t * n * min(caps[s], math.exp(min(600.0, b + x * t))) for y, b, t, n in rows if y == s)
    for s in "abc":  # brute force by bisection
        low, high = -5.0, 5.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if value(s, mid) < budgets[s] else (low, mid)
        assert abs(value(s, m[s]) / budgets[s] - 1) < 1e-8 and abs(m[s] - low) < 1e-6
    assert m["d"] == math.inf
    with pytest.raises(ArithmeticError):
        mixing.solve(sums, {"a": 0.6 * whole["a"]}, {"a": 1.0}, rounds=1)


def test_rates_are_tilted_by_tokens(spark):
    import math

    rows = [(i, "gene " * (1 + i % 40), "a" if i % 3 else "b", 1.0) for i in range(900)]
    targets = spark.createDataFrame([("a", 0.5, 50), ("b", 0.5, 50)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(spark.createDataFrame(rows, DOC), targets, total_tokens=14_000.0).collect()
    for s in "ab":
        r = {x["n_tokens"]: math.log(x["rate"]) for x in got if x["source"] == s}
        tilt = {round(y / t, 9) for t, y in r.items()}
        assert len(r) > 5 and len(tilt) == 1 and len(set(r.values())) == len(r)  # one multiplier, as many rates as sizes
    lack = mixing.shares(spark.createDataFrame(rows, DOC), targets, total_tokens=1e9).collect()
    assert all(x["lacks"] > 1e8 for x in lack) and abs(sum(x["share"] for x in lack) - 1) < 1e-9


SPAM = [
    "Looking for gene kit? gene kit here. Our gene kit beats other gene kit. Get gene kit today because gene kit gene kit. Cheap gene kit, gene kit deals!",
    "\n".join(f"http://site{i}.example/a/{i}" for i in range(12)),
    " | ".join(f"[gene kit {i}](http://x{i}.example/b)" for i in range(12)),
    " ".join(f"#tag{i}word" for i in range(20)),
    "Keywords: " + ", ".join(f"{a} {b} $9.99" for a in ("gene", "dna", "saliva") for b in ("kit", "test", "poster", "box")),
    "gene test Springford, Larham Bay gene test 24h, gene test Norbury, gene test Oldtown, Easton gene test 24h, gene test Weston, gene test Sutton",
    "B​uy ge​ne kIt, gene KIT cheap, GENE kit online, best gene kit, order gene kit, gene kit sale, gene kit now, gene kit top",
    "家系図 online, 家系図 best, 家系図 kaufen, 家系図 2025, 家系図 cheap, 家系図 review, 家系図 sale, 家系図 top, 家系図 fast, 家系図 order",
    "g e n e k i t o n l i n e  b u y g e n e k i t c h e a p  " * 4,
]
PROPER = [
    "+1, same here", "See https://a.example/x and https://b.example/y", None, "", " \n\t ",
    "I tried to merge the family file, but the log says that it is empty. What should I do with it when the header is missing?\n\ntags: family-file, header, merge, log",
    "```\n" + "gene kit " * 100 + "\n```\nThis is what I get.",
    "\n".join(["WARN merge: gene set indexed since last Tuesday"] * 30),
    "The genes of the panel are these.\n\n" + ", ".join(f"GEN{i}" for i in range(60)),
    "\n".join(f"{i}. [notes {i}](https://n{i}.example/p): This is what the authors say of it, and I think that they are right." for i in range(8)),
    "Every null model was noisy when the twin pair of that null model was filtered. The null model was stale because the gene set of that null model was split.",
    "$ tool --fam a.fam --out b\n$ tool --fam c.fam --out d\n" * 10,
]


def test_stuffed_pages(spark):
    rows = [(i, t, "s", 0.0) for i, t in enumerate(SPAM + PROPER)]
    got = {r["doc_id"]: (r["stuffed"], r["score"]) for r in spam.stuffed(spark.createDataFrame(rows, DOC)).collect()}
    assert {i: v for i, v in got.items() if v[0] != (i < len(SPAM))} == {}
    assert spam.stuffed(spark.createDataFrame([], DOC)).count() == 0
    mixed = SPAM[0] + "\n\n" + PROPER[5] * 6
    assert spam.score(mixed)[0] < 0.5 and spam.score(PROPER[5] + SPAM[0] * 40)[0] > 0.9


def test_long_texts_take_linear_time():
    import time

    for text in ("[a](" + "x" * 200_000, "<a href=" + "y" * 200_000, "1" + "-" * 200_000 + "x", "[" * 100_000, "<" * 100_000, "a " * 100_000, "`" * 100_001, "; " * 100_000, "```" + "z\n" * 100_000, "# " * 100_000, "http://" * 30_000):
        t = time.time()
        spam.score(text)
        assert time.time() - t < 10


def test_phrases_of_any_length_return_regularly():
    for phrase in ("best gene kit for your family tree online ", "the best gene kit for you and your family in Larham Bay and the towns of the coast ", "buy a saliva box for the family tree of your parents at the shop on the corner, "):
        assert spam.score(phrase * 200)[0] > 0.9, phrase
    assert spam.score("best gene kit for your family tree online " * 5)[0] > 0.9
    assert spam.score(" ".join(f"best gene kit for your family tree in {x}." for x in ("York", "Larham Bay", "Ely", "East Port", "Old Town") * 8))[0] > 0.9
    assert spam.score("I have the same question on the gene kit. " * 3)[0] < 0.5


def test_links_without_a_scheme():
    for form in ("shop{}.example/a", "kit{}shop.com", "//cdn{}.example/a", '<a href="/shop/all/the/shoes{}">shoes</a>', "[shoes](../shop/shoes{})", "магазин{}.рф"):
        s, n = spam.score("\n".join(form.format(i) for i in range(300)))
        assert s > 0.9 and n >= 600, form
    for form in ("file{}.py", "dir/file{}.txt", "sample.id{}", "// note {} of it", "sum[{}](x) += f.io(y)", "a{}@lab.example.com"):
        assert spam.score("\n".join(form.format(i) for i in range(300)))[0] == 0, form


def test_code_is_known_by_its_shape():
    words = ["gene kit", "dna test", "saliva box", "family tree", "ancestry poster"] * 8
    for text in (", ".join(f'"{w}"' for w in words), " ".join(f"[{w}]" for w in words), " ".join(f"({w})" for w in words), "\t" + ", ".join(words), "\n".join("    " + w for w in words), "cheap_gene_kit buy_gene_kit best_gene_kit " * 12, "iPhone15 PS5 GalaxyS24 " * 20):
        s, n = spam.score(text)
        assert s > 0.9 and n >= spam.LEAST, text
    for text in ('x = ["gene", "kit", "box"]', '["gene kit", "dna test", "saliva box"]', '{"gene kit": "dna test"}', "    for g in genes:\n        print(g)", "    tool --fam a.fam", "call(a, b)\nrun(x)", "\tS1\tS2\t0\t1", "sample_id, family_id, father_id, mother_id, pheno_name, loaded_at"):
        assert spam.score("\n".join([text] * 10))[0] == 0, text


def test_too_many_split_targets_raise(spark):
    targets = spark.createDataFrame([(f"s{i}", 1.0) for i in range(1001)], "split_name string, target_share double")
    with pytest.raises(ValueError, match="targets"):
        splits.assign(spark.createDataFrame([(1, "a", "x", None, None, "")], S), targets)


def test_edits_of_a_text_are_exact():
    with open(tokenizer.VOCABULARY, "rb") as f:
        e = tokenizer.Encoder(f.read())
    rng = random.Random(11)
    alphabet = ["gene", "Gen", " ", "  ", "\n", "\n\n ", "'s", "'", "12", "3", "!?", "é", "家系", "\t", "a", "x" * 30, ".", "don't"]
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for _ in range(300):
        t = tokenizer.EncodedText(e, make(rng.randrange(0, 60)))
        for _ in range(4):
            a = rng.randrange(len(t.text) + 1)
            b = min(len(t.text), a + rng.randrange(0, 9))
            t.edit(a, b, make(rng.randrange(0, 4)))
            assert t.pieces == e.split(t.text) and t.ids() == e.encode(t.text)
        t.append(make(3))
        assert t.ids() == e.encode(t.text)
    long = tokenizer.EncodedText(e, make(20_000))
    assert long.edit(5000, 5003, "gene") < 100 and long.ids() == e.encode(long.text)
