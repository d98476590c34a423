from foliant.llm.preference import format_preferences, mismatched_reply_pairs

TURNS = "array<struct<role:string,text:string>>"


def test_common_prefix_masks_and_ties(spark):
    sys, ask, good, bad = ("system", "be kind"), ("user", "hé?"), ("assistant", "yes"), ("assistant", "no")
    rows = [(1, [sys, ask, good], [sys, ask, bad], "x"), (2, [ask, good], [ask, good], "x"), (3, None, [ask], "x"), (4, [], [], None), (5, [(None, None), good], [(None, None), good, ask], "y")]
    out = {r.pair_id: r for r in format_preferences(spark.createDataFrame(rows, f"pair_id long, chosen {TURNS}, rejected {TURNS}, prompt string")).collect()}
    one = out[1]
    assert one.n_prompt_turns == 2 and one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhé?<|end|>\n"
    assert one.chosen.text == "<|assistant|>\nyes<|end|>\n" and one.differs
    assert "".join(one.chosen.text[s.start : s.end] for s in one.chosen.spans if s.train) == "yes<|end|>\n"
    assert out[2].differs is False and out[2].chosen.text == "" and out[2].rejected.spans == []
    assert out[3].n_prompt_turns == 0 and out[3].rejected.text.startswith("<|user|>")
    assert out[4].differs is False and out[4].prompt == ""
    assert out[5].n_prompt_turns == 2 and out[5].rejected.text == "<|user|>\nhé?<|end|>\n" and not any(s.train for s in out[5].rejected.spans)


def test_pairs_from_conversations(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 0, "user", "z"), (1, 1, "assistant", "b"), (2, 0, "user", "only"), (None, 0, "user", "lost"), (4, 0, None, None), (4, 1, "assistant", None)]
    out = {r.pair_id: r for r in mismatched_reply_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {0, 1, 4}
    assert [t.text for t in out[0].rejected] == ["q", "b"] and [t.text for t in out[4].rejected] == [""]
    assert mismatched_reply_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
