from millrace.operators import tasks


def _episodes(spark):
    rows = [(k, f"2026-03-0{1 + k // 2}", "open the chat app", "ok") for k in range(1, 6)]
    rows += [(9, "2026-03-01", "open chat app please", "failed"), (10, "2026-03-01", "weekly invoice report", "ok")]
    return spark.createDataFrame(rows, "id long, ts string, request string, outcome string")


def test_a_request_repeated_verbatim_is_a_habit(spark):
    got = tasks.promotions(_episodes(spark)).collect()
    assert [(r.trigger, r.uses, r.newest) for r in got] == [("open the chat app", 5, 5)]


def test_only_distinct_token_sets_are_joined(spark, monkeypatch):
    seen = []
    inner = tasks.similar_requests
    monkeypatch.setattr(tasks, "similar_requests", lambda e: seen.append(e.count()) or inner(e))
    got = {r.id: r.component for r in tasks.episode_clusters(_episodes(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10} and seen == [2]


def test_registered_queries_count_every_good_episode(spark):
    from millrace.plans import catalogue

    sf_dir = "/root/testdata/sf0.001"
    good = catalogue._episodes(spark, sf_dir).where("outcome = 'ok'").count()
    assert catalogue.episode_clusters(spark, sf_dir).count() == good
    first = catalogue.habit_promotion(spark, sf_dir).collect()[0]
    assert (first.uses, first.newest) == (136, 1482)
