"""Operators 11 to 13 on small tables, against plain loops."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Repeated phrases


def brute_phrases(docs):
    """(doc_id, n_words, n_removed, sha) for each row; rows of one id aren't earlier than each other, null ids come first."""
    rows = [(i, WORD.findall(t or "")) for i, t in docs]
    order = lambda i: (i is not None, i or 0)
    least = {}
    for i, w in rows:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            least[k] = min(least.get(k, order(i)), order(i))
    out = []
    for i, w in rows:
        gone, seen = set(), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if order(i) > least[k] or k in seen:
                gone.update(range(s, s + 20))
            seen.add(k)
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def phrases_of(spark, docs):
    from quern.llm.phrases import repeated_phrases

    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as sig", "'y' as marks", "'z' as copy", "1 as of", "2 as part")
    return sorted((tuple(r) for r in repeated_phrases(df).collect()), key=str)


def test_repeated_phrases_equal_plain_loops(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)] + ["é", "Été", "😀"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared, line = text(70), text(10)
    docs = []
    for i in range(60):
        body = text(rng.choice([0, 5, 19, 20, 21, 60, 150]))
        for _ in range(rng.randint(0, 3)):
            at, cut = rng.randint(0, len(body)), rng.randint(0, 50)
            body[at:at] = rng.choice([shared[cut : cut + rng.choice([19, 20, 25, 40])], line, line + line, body[:30]])
        docs.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(body)))
    docs += [(None, " ".join(shared)), (None, " ".join(shared)), (None, " ".join(text(5) + shared[3:60])), (7, " ".join(shared[:45])), (7, " ".join(text(9) + shared[5:50])), (100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1]), (3, docs[3][1])]
    docs += [(200, "a " * 500), (201, "a b " * 300), (202, " ".join(f"x{k % 37}" for k in range(900)))]
    assert phrases_of(spark, docs) == brute_phrases(docs)


def test_repeated_phrases_in_very_long_texts_and_small_shards(spark, monkeypatch):
    from quern.llm import phrases

    monkeypatch.setattr(phrases, "SHARD_WINDOWS", 40)
    monkeypatch.setattr(phrases, "PART_BYTES", 2_000)
    monkeypatch.setattr(phrases, "SLOT_BITS", 7)
    rng = random.Random(12)
    long = [f"v{rng.randint(0, 5_000)}" for _ in range(20_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[7_000:9_000] + ["new"] + long[100:160])), *((10 + k, " ".join([f"own{k}", *long[50:250]])) for k in range(40))]
    assert phrases_of(spark, docs) == brute_phrases(docs)


def test_repeated_phrases_of_an_empty_table(spark):
    assert phrases_of(spark, []) == []


def test_every_window_holds_a_whole_block_and_hashes_are_of_the_words():
    import numpy as np

    from quern.llm import phrases

    for start in range(200):
        assert any(start <= b and b + phrases.GRAM <= start + phrases.WINDOW for b in range(0, 300, phrases.SPAN))
    w = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x1234567)
    for n in (1, 2, 3, 8, 20, 59, 60):
        got = phrases.grams(w, n, phrases._A)
        want = [sum(int(x) * pow(int(phrases._A), n - 1 - k, 2**64) for k, x in enumerate(w[s : s + n])) % 2**64 for s in range(len(w) - n + 1)]
        assert got.tolist() == phrases.mix(np.array(want, np.uint64)).tolist()


# Conversation repair


def brute_edits(word):
    """Cheapest edits of a word, the ASCII-least of equal ones, by trying all of at most two inserts in a row."""
    best = None
    todo = [(0, "", 0, "", 0)]  # place, audit, cost, roles, inserts in a row
    while todo:
        at, audit, cost, roles, row = todo.pop()
        if best and cost > best[0]:
            continue
        if at == len(word) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if row < 2 and not re.fullmatch("s?(ua)*u?", roles):
            continue
        if row < 2:
            todo += [(at, audit + "I", cost + 3, roles + r, row + 1) for r in "ua"]
        if at < len(word):
            todo.append((at + 1, audit + "D", cost + 4, roles, 0))
            if word[at] != "x":
                extra = 3 * word[at].isupper()
                todo += [(at + 1, audit + "R", cost + 3 + extra, roles + r, 0) for r in "ua"] + [(at + 1, audit + "K", cost + extra, roles + word[at].lower(), 0)]
    return best


def test_suffix_automaton_equals_all_edits(spark):
    from quern.llm.repair import solve

    words = ["".join(w) for n in range(4) for w in itertools.product("suaoxSUA", repeat=n)]
    rng = random.Random(13)
    words += ["".join(rng.choice("suaxUA") for _ in range(5)) for _ in range(60)]
    got = {r.word: (r.cost, r.audit) for r in solve(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)).collect()}
    assert got == {w: brute_edits(w) for w in set(words)}


def test_nodes_are_made_once_for_each_suffix(spark, monkeypatch):
    from quern.llm import repair

    words = sorted({"".join(w) for n in range(5) for w in itertools.product("uax", repeat=n)}, key=lambda w: w[::-1])
    made, path, last = 0, [repair.END], ""
    for w in words:  # as a task does
        shared = next((k for k, (x, y) in enumerate(zip(reversed(w), reversed(last))) if x != y), min(len(w), len(last)))
        del path[shared + 1 :]
        for s in reversed(w[: len(w) - shared]):
            path.append(repair.node(s, path[-1]))
            made += 1
        last = w
    assert made == len({w[k:] for w in words for k in range(len(w))})


def brute_repair(rows):
    blank = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        turns = convs.setdefault(conv, [])
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        turns += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, word, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            cut = text.rstrip(blank)
            fault = "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "x" if fault in ("blank", "duplicate") else known.upper() if fault else known
        cost, audit = brute_edits(word)
        at, made = 0, []
        for e in audit:
            nxt = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if e == "I":
                made.append((nxt, ""))
                continue
            if e != "D":
                made.append((turns[at][1] if e == "K" else nxt, turns[at][2]))
            at += 1
        ts = {t for t, _, _ in turns if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(ts) - min(ts) + 1 - len(ts) if ts else 0, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def repair_of(spark, rows):
    from quern.llm.repair import damage, repair

    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as pos", "'x' as word", "'y' as audit", "2 as seen", "0 as code", "'z' as fault", "3 as id")
    return sorted((tuple(r) for r in repair(damage(df), df).collect()), key=str)


def test_conversation_repair_equals_plain_loops(spark):
    rng = random.Random(14)
    texts = ["Hello.", "Why?", "cut off", "", " \n", None, "Ok!", "no end...x", "é.", "\x0b. \t"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yo."), (500, None, "user", "A."), (500, None, "user", "A."), (500, 3, "assistant", "B."), (500, 3, "assistant", "B."), (501, 9, "user", "x" * 100_000)]
    dropped = next(c for c in range(1_000, 9_999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair_of(spark, [*rows, (dropped, 0, "user", "gone")])
    assert got == brute_repair([*rows, (dropped, 0, "user", "gone")])
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    assert repair_of(spark, []) == []


def test_conversation_repair_of_a_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3_000)]
    (got,) = repair_of(spark, rows)
    assert len(got[7].replace("I", "")) == sum({0: 0, 3: 2}.get(zlib.crc32(f"1:{t}".encode()) % 20, 1) for t in range(3_000))


# Filter audit


def brute_audit(docs, labels):
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), smaller)
        of = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", dict(zip("ABCDE", fails, strict=True)), any(q == 1 for _, q, _ in of), any(t == 1 for _, _, t in of)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                total[x] += len(here)
                failing = [r for r in mine if r[1][x]]
                out[part, "".join(order), step] = [len(left), len(here), len(failing) - sum(all(not r[1][y] for y in order[: step - 1]) for r in failing), sum(sum(r[1].values()) == 1 for r in failing), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("n", [0, 60])
def test_filter_audit_equals_plain_loops(spark, n):
    from quern.llm.audit import audit

    rng = random.Random(15)
    words = [f"w{k}" for k in range(300)] + ["BIG", "A$", "x|y", "é"]
    docs, labels = [], []
    for i in range(n):
        text = rng.choice([None, "", "\n\t", "same text", " ".join(rng.choice(words[: rng.choice([20, 304])]) for _ in range(rng.choice([99, 100, 150]))), "ABC " * 120, "w " * 5_000])
        docs.append((rng.choice([i, i, i, 5, None]), text, rng.choice(["en", "de", None, ""])))
        labels.append((rng.choice([i, i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "'x' as mask", "'y' as part", "'z' as digest", "0 as good", "0 as n")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got == brute_audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


# Bounds of earlier operators


def test_quality_bounds_rows_and_not_ids(spark, monkeypatch):
    from quern.llm import quality

    seen = []
    plain = quality.fit
    monkeypatch.setattr(quality, "MAX_LABELLED", 10)
    monkeypatch.setattr(quality, "fit", lambda x, label: seen.append(len(x)) or plain(x, label))
    docs = spark.createDataFrame([(i % 4, f"text {i} of some words.", None) for i in range(400)] + [(1, "the same text", None)] * 50, "doc_id bigint, text string, lang string")
    quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int"))
    assert seen == [10]


def test_decontamination_of_a_prompt_that_all_items_share(spark):
    from quern.llm import decontam

    prompt = "choose the right answer to this question about the text below and explain it"
    items = spark.createDataFrame([(i, f"{prompt} number{i} {' '.join(f'q{i}x{k}' for k in range(12))}") for i in range(2_000)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"a page with {prompt} and more"), (2, "nothing of it"), (None, prompt)], "doc_id bigint, text string")
    got = decontam.contaminated(docs, items)
    assert {r.doc_id: r.n for r in got.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()} == {1: 2_000, None: 2_000}


def test_decontamination_equals_all_alignments(spark):
    from quern.llm import decontam

    rng = random.Random(21)
    words = [f"w{k}" for k in range(9)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, text(rng.choice([3, 8, 13, 20]))) for i in range(12)]
    docs = []
    for d in range(60):
        w = text(rng.randint(0, 30))
        part = list(rng.choice(items)[1])
        for at in rng.sample(range(len(part)), min(len(part), rng.choice([0, 1, 2, 4]))):
            part[at] = "other"
        docs.append((d, w[:10] + part + w[10:]))

    def best(item, doc):
        size, most = min(len(item), 13), 0
        for shift in range(-len(item), len(doc)):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == x for i, x in enumerate(item)]
            most = max(most, *(sum(same[s : s + size]) for s in range(len(item) - size + 1)))
        return most, size

    want = {(d, i): best(item, doc)[0] for d, doc in docs for i, item in items if (lambda m, n: m == n if n < 8 else 100 * m >= 80 * n)(*best(item, doc))}
    got = decontam.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id): r.matched_words for r in got.collect()} == want


def test_token_counts_of_other_tokenizers_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["", "A few words, and more.", "don't  stop\n\n" * 40, "日本語 text", "x" * 3_000]
    got = tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    assert tokens.Lengths(public_tokenizers.path("byte_bpe_50k.json")).cut
