import random

from pyspark.sql import functions as F

from webloom.llm.chat import early_rejections, echo_rejections, preference_pairs, spans

TURNS = "conv_id long, turn long, role string, text string, prompt string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_prefix_is_rendered_once_and_the_rest_is_masked(spark):
    common = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi")]
    c = frame(spark, [*common, (1, 2, "assistant", "Hello!"), (1, 3, "user", "Bye"), (1, 4, "assistant", "Ciao")])
    r = frame(spark, [*common, (1, 2, "assistant", "Go away")])
    (got,) = preference_pairs(c, r).withColumn("s", spans(F.col("chosen_segments"))).collect()
    assert got.prefix_turns == 2
    assert got.prompt == "<|system|>\nBe kind.<|end|>\n<|user|>\nHi<|end|>\n"
    assert got.rejected == "<|assistant|>\nGo away<|end|>\n"
    assert "".join(s.text for s in got.chosen_segments) == got.chosen
    assert [got.chosen[x.start : x.end] for x in got.s] == ["Hello!<|end|>\n", "Ciao<|end|>\n"]


def test_awkward_pairs(spark):
    same = [(2, 0, "user", "q"), (2, 1, "assistant", "a")]
    c = frame(spark, [*same, (3, 0, "user", None), (3, 1, None, "x"), (3, 2, "assistant", "yes"), (None, 0, "user", "q"), (4, 0, "assistant", "only here"), (5, None, "user", "q"), (5, None, "user", "q"), (5, 1, "assistant", "long" * 50_000), (6, 0, "user", "q")])
    r = frame(spark, [*same, (3, 0, "user", None), (3, 1, None, "x"), (None, 0, "user", "q"), (5, None, "user", "q"), (5, None, "user", "q"), (5, 1, "assistant", ""), (6, 0, "user", "other")])
    got = {x.conv_id: x for x in preference_pairs(c, r).collect()}
    assert sorted(got) == [3, 5]
    assert got[3].prompt == "<|user|>\n<|end|>\n<|unknown|>\nx<|end|>\n" and got[3].rejected == "" and got[3].rejected_segments == []
    assert got[5].prefix_turns == 2 and got[5].rejected == "<|assistant|>\n<|end|>\n"


def test_echo(spark):
    t = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", "a")])
    got = {x.conv_id: (x.prompt, x.chosen, x.rejected) for x in preference_pairs(*echo_rejections(t)).collect()}
    head = "<|assistant|>\n"
    assert got == {1: ("<|user|>\nq<|end|>\n", head + "a<|end|>\n", head + "q<|end|>\n"), 3: ("<|user|>\n<|end|>\n", head + "a<|end|>\n", head + "<|end|>\n")}


def brute(turns):
    """(prefix_turns, prompt, chosen, rejected) by conv_id, turn by turn."""
    out, by = {}, {}
    for i, t, role, text in turns:
        if i is not None:
            by.setdefault(i, []).append((t is not None, t or 0, role or "unknown", text or ""))
    for i, rows in by.items():
        chosen = [r[2:] for r in sorted(rows)]
        at = [k for k, (role, _) in enumerate(chosen) if role == "assistant" and k]
        if not at:
            continue
        k = at[i % len(at)]
        rejected = [*chosen[:k], ("assistant", chosen[k - 1][1]), *chosen[k + 1 + (i % 2 == 0) :]]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
        if any(r == "assistant" and t for r, t in chosen[n:] + rejected[n:]):
            out[i] = (n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]))
    return out


def test_early_rejections_match_a_plain_version(spark):
    rng = random.Random(3)
    turns = [(i, t, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(["a", "b", "c", "", None])) for i in range(120) for t in range(rng.randint(1, 7))]
    turns += [(None, 0, "user", "q"), (500, None, "user", "q"), (500, 1, "assistant", "x" * 300_000), (500, 1, "assistant", "x" * 300_000), (501, 0, "user", "same"), (501, 1, "assistant", "same")]
    got = {x.conv_id: (x.prefix_turns, x.prompt, x.chosen, x.rejected) for x in preference_pairs(*early_rejections(frame(spark, turns))).collect()}
    assert got == brute(turns) and len({n for n, *_ in got.values()}) > 3


def test_string_keys_and_clashing_names(spark):
    t = spark.createDataFrame([("a", 0, "user", "q", 1, 2), ("a", 1, "assistant", "r", 1, 2)], "conv_id string, turn int, role string, text string, key int, n int")
    (got,) = preference_pairs(*early_rejections(t)).collect()
    assert (got.conv_id, got.prefix_turns, got.rejected) == ("a", 1, "<|assistant|>\nq<|end|>\n")


def test_empty_tables(spark):
    t = frame(spark, [])
    assert preference_pairs(*early_rejections(t)).count() == 0
    assert preference_pairs(*echo_rejections(t)).count() == 0
