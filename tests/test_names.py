from foliant.operators.merge import best_name_match


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_best_names_against_brute_force_without_a_broadcast_of_windows(spark, tmp_path):
    wanted = ["Eco", "eco line", " ab ", "a", "", None, "zzz", "Line", "ECO"]
    names = ["eco", "ECO ", "economy", "an eco line", "eco line", "ab", "abc", "", None, "online", "a"]
    given = spark.createDataFrame([(x,) for x in wanted], "name string")
    spark.createDataFrame([(50 - i, x) for i, x in enumerate(names * 3)], "id long, name string").write.parquet(f"{tmp_path}/known")
    known = spark.read.parquet(f"{tmp_path}/known")  # a table of known size, small enough to be sent
    want = {}
    for x in wanted:
        w = (x or "").strip().lower()
        found = [(k != w, len(k), i) for i, n in known.collect() for k in [(n or "").strip().lower()] if w and (k == w or len(w) >= 3 and w in k)]
        if found:
            want[x] = min(found)[2]
    out = best_name_match(given, known)
    assert dict(out.collect()) == want and len(want) == 6
    sent = [n for n in nodes(out._jdf.queryExecution().executedPlan().initialPlan()) if n.nodeName() == "BroadcastExchange"]
    assert not [n for x in sent for n in nodes(x) if n.nodeName() == "Generate"]
