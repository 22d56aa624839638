"""Operators 11 to 13: repeated passages, spelling variants, conversation repair."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from hueweave.llm import oracle, queries, repair, suffix_dedup, variants


def spans_by_hand(texts, length):
    """Maximal covered runs of each text's bytes, by counting all strings."""
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        hit = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                hit[p : p + length] = [True] * length
        runs = [(k, len(list(g))) for k, g in itertools.groupby(hit)]
        ends = list(itertools.accumulate(n for _, n in runs))
        out.append([(e - n, e) for (k, n), e in zip(runs, ends) if k])
    return out


def passages(seed):
    r = random.Random(seed)
    bits = ["".join(r.choices("ab", k=r.randint(5, 60))) for _ in range(6)]
    shared = ["".join(r.choices("abcd", k=r.randint(8, 40))) for _ in range(6)]
    out = [None, "", "é", "a" * 90, "a" * 30, "ab" * 40, "short"]
    for _ in range(40):
        out.append("".join(r.choice([*bits, *shared, "".join(r.choices("abcdefgh", k=r.randint(1, 30)))]) for _ in range(r.randint(1, 4))))
    return [*out, out[9], out[9], "né " * 20]


@pytest.mark.parametrize(("length", "most"), [(12, 50_000), (12, 1), (33, 50_000), (33, 2), (1, 3), (2, 50_000)])
def test_repeats_against_brute_force(spark, length, most):
    texts = passages(length + most)
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame([(None if i == 5 else i % 40, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in suffix_dedup.remove_repeats(docs, length, most).collect()), key=repr)
    want = []
    for i, (t, spans) in enumerate(zip(raw, spans_by_hand(raw, length))):
        kept = b"".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
        want.append((i == 5, 0 if i == 5 else i % 40, len(t), kept, spans))
    assert got == sorted(want, key=repr)


def test_repeats_at_production_length(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    shared = [prose(60), prose(90), prose(200), "z" * 900]
    texts = [prose(r.randint(5, 150)) + " " + (r.choice(shared)[r.randint(0, 50) :] if r.random() < 0.7 else "") + prose(r.randint(0, 90)) for _ in range(60)]
    texts += [texts[0], texts[1] + "!", "-" + texts[2]]
    raw = [t.encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.remove_repeats(docs).collect()}
    want = dict(enumerate(spans_by_hand(raw, 400)))
    assert got == want and sum(map(len, want.values())) > 20


def test_shared_passages_count_by_bytes_not_words(spark, tmp_path):
    words = lambda size: " ".join(f"{i:0{size}d}" for i in range(60))
    short, long = words(5), words(6)  # 60 words of 359 and of 419 bytes
    texts = ["a" + short + "b", "c" + short, "d" + long + "e", "f" + long, "g"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in queries.op11_suffixes(spark, str(tmp_path)).collect()}
    assert got == {0: (361, 0, 0), 1: (360, 0, 0), 2: (421, 419, 1), 3: (420, 419, 1), 4: (1, 0, 0)}


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(none).collect() == [] and variants.group_variants(none).collect() == []
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_places_do_not_depend_on_pieces_or_surroundings():
    r = random.Random(1)
    text = bytes(r.choices(b"abc ", k=3000)) + b"x" * 600 + bytes(r.choices(b"abc ", k=900))
    whole = suffix_dedup.places(text, 400)
    assert (whole == suffix_dedup.places(text, 400, 77)).all()
    window = suffix_dedup.sizes(400)[0]
    for p in range(0, len(text) - 400, 37):  # each string holds a place of its own, at one offset wherever it stands
        own = suffix_dedup.places(text[p : p + 400], 400)
        assert len(own) and own[0] < window and set(own + p) <= set(whole)


def test_merge_of_front_coded_runs():
    r = random.Random(2)
    rows = [(bytes(r.choices(b"ab", k=r.randint(0, 12))), b"", i, 0, 1) for i in range(300)]
    for k in (1, 2, 3, 7):
        runs = [suffix_dedup.front_coded(sorted(rows[i::k])) for i in range(k)]
        out = list(suffix_dedup.merged([suffix_dedup.decoded(x) for x in runs]))
        assert [o[1] for o in out] == sorted(x[0] for x in rows)
        assert sorted(o[3] for o in out) == list(range(300))
        for a, b in itertools.pairwise(out):
            assert b[0] == suffix_dedup.agreement(a[1], b[1])
    assert list(suffix_dedup.merged([])) == []


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms_by_hand(words, ratio=10):
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best is not None and words[best] >= ratio * n else None, len(close)]
    rows = []
    for w, (form, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, words[w], m, words[form] if form else None))
    return sorted(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choices("abé", k=r.randint(1, 6))): r.choice([2, 3, 20, 30, 200, 300, 3000]) for _ in range(250)}
    words |= {"a" * i: 10**i for i in range(1, 8)} | {"z" * 300: 2, "z" * 299: 50, "日本語": 4, "日本": 4}
    got = variants.variant_forms(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5))
    assert sorted(tuple(x) for x in got.collect()) == forms_by_hand(words)


def test_words_with_typing_errors(spark):
    texts = [(1, "Grüße, GRÜßE straßenbahn's Überraschung × naïveté÷naïveté"), (2, None), (None, "straßenbahn straßenbahn"), (3, ""), (4, "ÀÉ" * 400)] + [(i, "information Information informations shorter") for i in range(5, 80)]
    want = {}
    for d, t in texts:
        run = ""
        for ch in (t or "") + " ":
            if "a" <= ch.lower() <= "z" and ch.isascii() or "À" <= ch <= "ÿ":
                run += ch
            elif run:
                x = "".join(c.lower() if c.isascii() else c for c in run)
                h = zlib.crc32(f"{'' if d is None else d}:{x}".encode())
                if h % 31 == 0:
                    x = x[: h % len(x)] + x[h % len(x) + 1 :]
                if len(x) >= 7:
                    want[x] = want.get(x, 0) + 1
                run = ""
    docs = spark.createDataFrame([(d, t, "w") for d, t in texts], "doc_id long, text string, word string")
    assert {r["word"]: r["n"] for r in variants.typed_words(docs).collect()} == want
    assert sorted(tuple(x) for x in variants.group_variants(docs).collect()) == forms_by_hand({w: n for w, n in want.items() if n > 1})


def cheapest_by_hand(signature):
    """Least (cost, audit) over the states, with audits as whole strings."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserted(base):
        for _ in range(3):
            base = [min([base[k], *[(base[t][0] + 5, "I" + base[t][1]) for (f, x), t in after.items() if f == k and x != "s"]]) for k in range(4)]
        return base

    best = inserted([(0, ""), (999, ""), (999, ""), (0, "")])
    for x in reversed(signature):
        base = []
        for k in range(4):
            options = [(best[k][0] + 2, "D" + best[k][1])]
            if x != "x":
                late = 5 * x.isupper()
                options += [(best[t][0] + late, "K" + best[t][1]) for (f, y), t in after.items() if f == k and y == x.lower()]
                options += [(best[t][0] + late + 1, "R" + best[t][1]) for (f, y), t in after.items() if f == k and y != "s"]
            base.append(min(options))
        best = inserted(base)
    return best[0]


def test_edits_against_brute_force(spark):
    r = random.Random(4)
    signatures = {"".join(r.choices("suaoSUAOx", k=r.randint(1, 9))) for _ in range(1500)} | {"ua" * 500 + "u", "x" * 300, "us" * 100, "u" * 50, "a"}
    got = repair.cheapest_edits(spark.createDataFrame([(s,) for s in signatures], "signature string").repartition(3))
    assert {x["signature"]: (x["cost"], x["audit"]) for x in got.collect()} == {s: cheapest_by_hand(s) for s in signatures}


def repaired_by_hand(rows):
    """Rows (turn, role, text), damaged: the row of results for one conversation."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, signature, counts, illegal = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}, 0
    for i, (_, _, role, text) in enumerate(rows):
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signature += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
        illegal += i > 0 and rows[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = cheapest_by_hand(signature)
    turns = [t for known, t, _, _ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    lines = []
    for edit, at, role in repair.walk(signature, audit):
        if edit != "D":
            lines.append(f"{role or rows[at][2]}:{'' if edit == 'I' else rows[at][3]}")
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def talks():
    r = random.Random(5)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 12)):
            rows.append((c or None, None if r.random() < 0.1 else t + (r.random() < 0.1), r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice(["Yes.", "No!", "cut off", "  ", "", None, f"Number {t}?", "Done.\n "])))
    return [*rows, *rows[:5], (900, 1, "user", "gone")]


def test_repair_against_brute_force(spark):
    by = {}
    for c, *row in talks():
        by.setdefault(c, []).append(row)
    talk = spark.createDataFrame([(*x, "clash") for x in talks()], "conv_id long, turn long, role string, text string, audit string")
    got = {x["conv_id"]: tuple(x)[1:] for x in repair.repair_conversations(talk).collect()}
    assert got == {c: repaired_by_hand(rows) for c, rows in by.items()}


def test_repaired_turns_follow_the_grammar(spark):
    talk = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    faults = repair.find_faults(talk)
    out = repair.repaired_turns(faults, repair.audit_conversations(faults)).collect()
    by = {}
    for x in sorted((x for x in out if x["edit"] != "D"), key=lambda x: (str(x["conv_id"]), x["place"])):
        assert x["place"] == len(by.setdefault(x["conv_id"], []))
        by[x["conv_id"]].append(x["role"][:1])
    for roles in by.values():
        s = "".join(roles).removeprefix("s")
        assert s and s == "ua" * (len(s) // 2)


def test_long_conversations_are_spelt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 3)
    by = {c: [(t, ("user", "assistant")[t % 2] if t % 7 else "user", f"Turn {t}.") for t in range(40 + c)] for c in range(3)}
    talk = spark.createDataFrame([(c, *x) for c, rows in by.items() for x in rows], "conv_id int, turn int, role string, text string")
    assert {x["conv_id"]: tuple(x)[1:] for x in repair.repair_conversations(talk).collect()} == {c: repaired_by_hand(rows) for c, rows in by.items()}


@pytest.mark.parametrize("name", ["op12_variants", "op13_repair"])
def test_sql(spark, tmp_path, name):
    talk = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(i, f"wonderful wonderfull wonderfal straßenbahn Straßenbahn {'wonderful ' * (i % 9)}naïveté") for i in range(90)] + [(None, None), (7, "")], "doc_id long, text string")
    talk.write.parquet(f"{tmp_path}/conversations.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({oracle.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want


def test_own_marks_are_escaped_and_ids_of_any_type_read_back(spark):
    from hueweave.llm import chat

    t = chat.Template(head="<u>{role}:", tail="</u>")
    said = [(7, 0, "us:er\n%3A", "a</u>"), (7, 1, "assistant", "<u>x: </u></u> \\ </"), (None, 0, "user", "")]
    talk = spark.createDataFrame(said, "conv_id smallint, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(talk, t), t).collect()}
    want = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in said[:2]).encode()).hexdigest()
    assert got[7]["turns_sha256"] == want and got[7]["n_turns"] == 2 and got[None]["n_turns"] == 1
    for head, tail in (("{role}", "x"), ("no role", "x"), ("{role}\n", "\n"), ("{role}:", "")):
        with pytest.raises(ValueError, match="a head holds"):
            chat.Template(head=head, tail=tail)


def test_columns_of_any_name_and_type_stay(spark):
    from hueweave.llm import quality, simhash

    text = " ".join(f"word{i} the" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", 5, 6, 7, {"a": 1}), (1, text, "en", 5, 6, 7, {"a": 1}), (2, "short", None, 8, 9, 1, None)], "doc_id long, text string, lang string, _hw_words int, classes int, common int, m map<string, int>")
    judged = quality.quality_rules(docs)
    assert set(docs.columns) <= set(judged.columns) and sorted(r["_hw_words"] for r in judged.collect()) == [5, 5, 8] and sorted(r["classes"] for r in judged.collect()) == [6, 6, 9]
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["_hw_words"], str(r["m"])) for r in kept) == [(1, 5, "{'a': 1}"), (2, 8, "None")]
