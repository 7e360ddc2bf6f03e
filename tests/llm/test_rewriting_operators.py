"""Chat formatting, mixing and surrogates: round trips, brute force, edge cases, and plans without Python."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm import chat, pii
from feedloom.llm.mixing import find_exponent, mix_rows, token_count
from feedloom.llm.pii import assign, replace_entities

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_events_fold_to_the_last_state(spark):
    rows = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 1, 0, "delta", None, "lo"), (1, 2, 1, "delta", "assistant", "bad"), (1, 3, 1, "regenerate", "assistant", None),
        (1, 4, 1, None, "assistant", "go"), (1, 5, 1, "delta", None, "od"), (1, 6, 0, "edit", None, "Bye"), (1, 7, 0, "delta", None, "!"), (1, 8, 2, "regenerate", None, "x"),
        (None, 1, None, "delta", None, None), (2, None, 0, "delta", "user", "late"),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS).repartition(5)).collect()}
    assert got == {(1, 0): ("user", "Bye!"), (1, 1): ("assistant", "good"), (1, 2): ("", ""), (None, None): ("", ""), (2, 0): ("user", "late")}


CONVERSATIONS = {
    -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")],
    1: [("system", "a & b &amp; &lt; &lsqb; <|end|>\n<|turn|>"), ("user", ""), ("assistant", "x\ny\n"), ("assistant", "é🙂&lt;")],
    2: [("user\n<", "only")],
    3: [("assistant", "")],
    4: [("user", f"turn {i} <|turn|>assistant\n") for i in range(300)],
    5: [("assistant", "long & " * 200_000)],
}


def test_formatted_text_reads_back(spark):
    rows = [(c, t, role, text, "clash") for c, turns in CONVERSATIONS.items() for t, (role, text) in enumerate(turns)] + [(7, 0, None, None, "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_conversations(chat.events_of(frame))
    texts = {r.conv_id: r for r in formatted.collect()}
    got = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert got.keys() == {*CONVERSATIONS, 7}
    for conv, turns in CONVERSATIONS.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
        assert got[conv].formatted_chars == len(texts[conv].formatted)
        assert texts[conv].formatted.count(chat.OPEN) == len(turns) and "[INST]" not in texts[conv].formatted and "</s>" not in texts[conv].formatted
        spans = [texts[conv].formatted[s.start : s.start + s.length] for s in texts[conv].loss_spans]
        assert [s.replace("&lsqb;", "[").replace("&lt;", "<").replace("&amp;", "&") for s in spans] == [text for role, text in turns if role == "assistant"]
    assert (got[7].n_turns, got[7].turns_sha256, got[7].loss_chars) == (1, sha("\n\n"), 0)
    assert chat.digest(chat.format_conversations(chat.events_of(frame.limit(0)))).collect() == []


def test_tied_roles_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "user", "b"), (1, 1, "assistant", "a"), (1, 1, None, "n"), (2, None, "user", "x"), (2, None, "assistant", "y"), (3, 0, "user", "2"), (3, 0, "user", "1"), (4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.events_of(frame))).collect()}
    assert {c: (r.n_turns, r.loss_chars) for c, r in got.items()} == {1: (4, 1), 2: (2, 1), 3: (2, 0), 4: (3, 2)}
    assert got[1].turns_sha256 == sha("user\nq\n\nn\nassistant\na\nuser\nb\n") and got[1].loss_sha256 == sha("a")
    assert got[2].turns_sha256 == sha("assistant\ny\nuser\nx\n") and got[3].turns_sha256 == sha("user\n1\nuser\n2\n")
    assert got[4].turns_sha256 == sha("user\nq\nassistant\na\nassistant\na\n") and got[4].loss_sha256 == sha("aa")


def test_chat_and_surrogates_plan_no_python(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    docs = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    for df in (chat.digest(chat.render(chat.fold(chat.events_of(frame)))), replace_entities(docs, "k")):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def mixed(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, whole int").repartition(3)
    return frame, mix_rows(frame, **settings).collect()


def test_weights_epochs_and_budget(spark):
    sizes = {"a": 600, "b": 120, "c": 40, None: 10}
    rows = [(10_000 * k + i, "x" * (40 + 4 * (i % 7)), s, 0) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    frame, got = mixed(spark, rows, entropy=0.9, repetitions=3.0, block_tokens=200)
    tokens = {s: sum(math.ceil(len(r[1]) / 4) for r in rows if r[2] == s) for s in sizes}
    total = sum(tokens.values())
    counts = {}
    for r in got:
        counts.setdefault(r.doc_id, []).append(r.mix_epoch)
    assert set(counts) == {r[0] for r in rows}, "every document stays"
    assert all(sorted(e) == list(range(len(e))) for e in counts.values())
    drawn = {s: sum(r.mix_tokens for r in got if r.source == s) for s in sizes}

    exponent = find_exponent(frame.groupBy("source").agg(F.sum(token_count(F.col("text"))).alias("tokens")), total, 0.9, 3.0)
    power = {s: (t / total) ** exponent for s, t in tokens.items()}
    z = sum(power.values())
    weights = {s: p / z for s, p in power.items()}
    entropy = -sum(w * math.log(w) for w in weights.values()) / math.log(len(weights))
    spread = max(weights[s] / tokens[s] for s in sizes) / min(weights[s] / tokens[s] for s in sizes)
    assert spread <= 3.0 + 1e-6 and (entropy >= 0.9 - 1e-6 or spread >= 3.0 - 1e-4)
    budget = max(tokens[s] / weights[s] for s in sizes)
    for s in sizes:
        assert weights[s] * budget - 1e-6 <= drawn[s] < weights[s] * budget + 17


def test_a_given_budget_cuts_large_sources_too(spark):
    rows = [(i, "x" * 40, "a", 0) for i in range(300)] + [(1000 + i, "x" * 40, "b", 0) for i in range(50)]
    _, got = mixed(spark, rows, entropy=1.0, repetitions=100.0, budget=2000.0, block_tokens=100)
    drawn = {s: sum(r.mix_tokens for r in got if r.source == s) for s in "ab"}
    assert drawn == {"a": 1000, "b": 1000}
    assert max(r.mix_epoch for r in got if r.source == "b") == 1 and max(r.mix_epoch for r in got if r.source == "a") == 0
    again = mixed(spark, rows, entropy=1.0, repetitions=100.0, budget=2000.0, block_tokens=100)[1]
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_blocks_follow_the_order_of_an_epoch(spark):
    rows = [(i, "x" * 40, "a", 0) for i in range(400)]
    _, got = mixed(spark, rows, budget=6000.0, entropy=0.0, repetitions=9.0, block_tokens=500)
    orders = [[{r.doc_id for r in got if r.mix_epoch == e and r.mix_block == b} for b in range(8)] for e in (0, 1)]
    assert sum(map(len, orders[0])) == 400 and sum(map(len, orders[1])) == 200
    assert orders[0] != orders[1] and all(not b for b in orders[1][6:])


def test_mixing_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (1, "", "a", 1), (1, "", "a", 1), (2, "y" * 1_000_000, "b", 2)]
    _, got = mixed(spark, rows)
    assert {(r.doc_id, r.source) for r in got} == {(None, None), (1, "a"), (2, "b")}
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_rows(frame).collect() == []
    one = mix_rows(spark.createDataFrame([(1, "t", "s", 9)], "doc_id long, text string, source string, mix_epoch int"))
    assert one.columns[-3:] == ["_mix_epoch", "mix_block", "mix_tokens"] and one.count() == 1


PRIVATE = [
    "jo.81@mail7.example.com", "97.51.17.173", "9807915762804490", "+1 (017) 555-7713", "04dbebab91ab85687d33eeaaf9ac699e1188f962", "123-45-6789", "DE89 3704 0044 0532 0130 00",
]


def test_entities_are_replaced_and_nothing_else(spark):
    texts = [f"before {p}, after." for p in PRIVATE] + [
        "Ask JO.81@MAIL7.EXAMPLE.COM or +1-017-555-7713 now", "clean text version 3, CC BY-NC 4.0 in 2020", None, "", "Mrs Anna Meier met Mr Bob and г-жа Иванова.", 'token = "abc-DEF_123xyz"',
        "twice 97.51.17.173 and 97.51.17.173 " + "filler " * 100_000,
    ]
    frame = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(None, texts[0], "e"), (0, texts[0], "e")], "doc_id long, text string, entities string").repartition(3)
    rows = replace_entities(frame, key="k").collect()
    assert len(rows) == len(texts) + 2 and rows[0].asDict().keys() == {"doc_id", "text", "entities", "_entities"}
    got = {r.doc_id: r.text for r in rows}
    for i, p in enumerate(PRIVATE):
        new = got[i].removeprefix("before ").removesuffix(", after.")
        assert p not in got[i] and len(got[i]) and new != p
        if "@" not in p and "." not in p:
            shape = lambda s: re.sub("[a-z]", "a", re.sub(r"\d", "9", s)) if len(s) != 40 else len(s)
            assert shape(new) == shape(p)
    assert all(int(o) < 256 for o in got[1].split()[1].rstrip(",").split("."))
    n = len(PRIVATE)
    assert got[n].split()[1].lower() == got[0].split()[1].rstrip(","), "one surrogate for both spellings"
    assert re.sub(r"\D", "", got[n].split()[3]) == re.sub(r"\D", "", got[3])
    assert got[3].endswith(", after.") and replace_entities(spark.createDataFrame([(1, "+1 (017) 555-7713 1.2.3 4.0")], "doc_id long, text string"), key="k").first().text.endswith(" 1.2.3 4.0")
    assert got[n + 1] == texts[n + 1] and got[n + 2] is None and got[n + 3] == ""
    assert re.fullmatch(r"Mrs [A-Z][a-z]+a [A-Z][a-z]+ met Mr [A-Z][a-z]+o and г-жа [А-Я][а-я]+а\.", got[n + 4]) and "Anna" not in got[n + 4]
    assert re.fullmatch(r'token = "[a-z]{3}-[A-Z]{3}_\d{3}[a-z]{3}"', got[n + 5]) and "abc-DEF" not in got[n + 5]
    first, second = re.findall(r"\d+\.\d+\.\d+\.\d+", got[n + 6])
    assert first == second != "97.51.17.173"
    assert {r.text for r in rows if r.doc_id in (None, 0)} == {got[0]}
    other = {r.doc_id: r.text for r in replace_entities(frame, key="other").collect()}
    assert other[0] != got[0]
    assert replace_entities(frame.limit(0), key="k").collect() == []


BARE = {
    "sk-" + "abcdefghijklmnopqrstuvwx": "assigned", "ghp_" + "abcdefghijklmnopqrstuvwxyzabcdefghij": "assigned", "ASIA" + "ABCDEFGHIJKLMNOP": "assigned",
    "abcdefabcdefabcdefabcdefabcdefabcdef": "secret", "ABCDEF" * 6: "secret", "١٩٢.١٦٨.١.١٠": "ip",
}


def test_the_cheap_test_passes_every_entity(spark):
    """Entities without a digit, or with digits of another script, are found like any other."""
    frame = spark.createDataFrame([(i, f"so {t} it is") for i, t in enumerate(BARE)], "doc_id long, text string")
    for r in replace_entities(frame, key="k").collect():
        text, kind = list(BARE.items())[r.doc_id]
        assert [e.kind for e in r.entities] == [kind] and text not in r.text and r.text.startswith("so ") and r.text.endswith(" it is"), r.text
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert docs.where(~F.col("text").rlike(pii.HINT) & F.col("text").rlike(pii.ENTITY)).count() == 0


PHONES = ["+33 1 23 45 67 89", "+7 (495) 123-45-67", "+33 (0)1 23 45 67 89", "+34 (91) 123 45 67", "+49 30 12 34 56 78", "+4930123456789", "+1 (017) 555-7713", "+9-017-555-7713"]


@pytest.mark.parametrize("after", [" now", ".", " 1.2.3 4.0"])
def test_phone_numbers_of_any_grouping_are_whole(spark, after):
    frame = spark.createDataFrame([(i, f"call {p}{after}") for i, p in enumerate(PHONES)], "doc_id long, text string")
    for r in replace_entities(frame, key="k").collect():
        new = r.text.removeprefix("call ").removesuffix(after)
        assert len(r.entities) == 1 and r.entities[0].kind == "phone" and r.entities[0].surrogate == new != PHONES[r.doc_id]
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", PHONES[r.doc_id])


PEOPLE = {
    "Mrs Anna Smith came. Smith left, not Smithson.": r"Mrs (\w+a) (\w+a) came\. \2 left, not Smithson\.",
    "Mrs Smith and Mrs Anna Smith and MRS": r"Mrs (\w+a) and Mrs \w+a \1 and MRS",
    "Mr J. Smith and Mr. J.R. Smith": r"Mr J\. (\w+o) and Mr\. J\.R\. \1",
    "Mrs Μαρία is here": r"Mrs [Α-Ω][α-ω]+α is here", "г-н Иван Петров. Петров ушёл.": r"г-н [А-Я][а-я]+ор ([А-Я][а-я]+ор)\. \1 ушёл\.",
    "Herr O'Neil-Maier: O'Neil-Maier": r"Herr (\w+o): \1", "Smith alone, smith": r"Smith alone, smith", "Frau Will will": r"Frau \w+a will",
}


def test_names_keep_reference_gender_and_script(spark):
    """A family name is one surrogate with a given name, with initials, and alone in its text; other words stay."""
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(PEOPLE)], "doc_id long, text string, families int")
    got = {r.doc_id: r for r in replace_entities(frame, key="k").collect()}
    for i, (text, pattern) in enumerate(PEOPLE.items()):
        assert re.fullmatch(pattern, got[i].text), (text, got[i].text)
    first = re.fullmatch(PEOPLE[list(PEOPLE)[0]], got[0].text).group(2)
    assert first == re.fullmatch(PEOPLE[list(PEOPLE)[1]], got[1].text).group(1), "one person in two texts"
    assert [e.kind for e in got[0].entities] == ["female", "female"] and [e.kind for e in got[6].entities] == []


def test_secrets_of_any_length(spark):
    long = "aB3_" * 75
    secrets = {f'token = "{long}"': long, f"key sk-{long} end": f"sk-{long}", f"hash {'0a1b' * 64} end": "0a1b" * 64, '{"password": "hunter22"}': "hunter22", "{'api_key':'hunter22'}": "hunter22"}
    frame = spark.createDataFrame(list(enumerate(secrets)), "doc_id long, text string")
    for r in replace_entities(frame, key="k").collect():
        text, secret = list(secrets.items())[r.doc_id]
        assert len(r.entities) == 1 and secret not in r.text
        assert r.text == text.replace(secret, r.entities[0].surrogate) and len(r.entities[0].surrogate) == len(secret)


def test_surrogates_stay_distinct(spark):
    """Ten thousand names and addresses from small spaces collide in the first round and part in later ones."""
    values = [("male", f"name{i}") for i in range(6000)] + [("ip", f"10.0.{i // 256}.{i % 256}") for i in range(4000)]
    rows = assign(spark.createDataFrame(values, "kind string, value string"), "key").collect()
    assert {(r.kind, r.value) for r in rows} == set(values)
    assert len({r.surrogate for r in rows}) == len(values)
    assert not {r.surrogate for r in rows} & {v for _, v in values}


@pytest.mark.parametrize("size", ["sf0.01"])
def test_nothing_private_is_left_in_the_table(spark, size):
    documents = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    before = {r.doc_id: r.text for r in documents.collect()}
    after = {r.doc_id: r.text for r in replace_entities(documents, key="k").collect()}
    found = re.compile(r"[\w.]+@[\w.]+\.\w+|\d+\.\d+\.\d+\.\d+|\b\d{16}\b|\+\d \(\d+\) \d+-\d+|[0-9a-f]{40}|[0-9A-F]{40}")
    private = {m for t in before.values() for m in found.findall(t)}
    assert len(private) > 50
    assert not private & {m for t in after.values() for m in found.findall(t)}
    for i, text in before.items():
        if not found.search(text):
            assert after[i] == text
        else:
            assert [len(p) for p in found.split(text)] == [len(p) for p in found.split(after[i])]
