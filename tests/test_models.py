"""Models on small inputs: exact where there is a closed form, invariants elsewhere."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot import ListeningLog
from earshot.models import bayes, next_song, next_time, recommend, store
from earshot.operators import items
from earshot.operators.splits import random_split, with_split
from earshot.operators.users import last_play_by_user, numbers_of, plays_with_profile
from earshot.sources.profiles import with_profile_numbers


@pytest.fixture(scope="module")
def plays(make_plays, skewed_rows):
    return make_plays(skewed_rows).persist()


@pytest.fixture(scope="module")
def profiles(spark):
    raw = spark.createDataFrame(
        [("user_000001", "m", 30, "Peru"), ("user_000002", "F", 0, "Japan"), ("user_00001", "f", 99, "Chile")],
        "user string, gender string, age int, country string",
    )
    return with_profile_numbers(raw)


@pytest.fixture(scope="module")
def crowd(make_plays):
    """40 users, one of whom heard nearly everything and one who heard it all."""
    rng = random.Random(3)
    rows = []
    for user in range(1, 41):
        count = {1: 30, 2: 29}.get(user, rng.randrange(3, 12))
        for song in rng.sample(range(30), count):
            for play in range(rng.randrange(1, 5)):
                rows.append((f"user_{user:06d}", play * 1000 + song, f"art_{song // 2}", f"song_{song:02d}"))
    return make_plays(rows).persist()


def test_item_index_is_dense_and_repeatable(plays):
    index = items.item_index(plays, "songId").collect()
    assert sorted(r.item_index for r in index) == list(range(len(index)))
    assert len({r.songId for r in index}) == len(index) == plays.select("songId").distinct().count()
    assert sorted(items.item_index(plays.repartition(5), "songId").collect()) == sorted(index)


def test_item_numbers_last(spark, crowd, tmp_path):
    first = crowd.where("user_id <= 2 AND songId < 'song_20'")
    one = {r.songId: r.item_index for r in items.item_index(first, "songId").collect()}
    kept = items.item_index(first, "songId")
    two = {r.songId: r.item_index for r in items.extended_index(kept, crowd, "songId").collect()}
    assert all(two[song] == number for song, number in one.items()) and len(two) > len(one)
    assert sorted(two.values()) == list(range(len(two)))
    gone = items.extended_index(items.extended_index(kept, crowd, "songId"), first.limit(3), "songId")
    assert {r.songId: r.item_index for r in gone.collect()} == two
    assert sorted(items.extended_index(kept.limit(0), first, "songId").collect()) == sorted(items.item_index(first, "songId").collect())
    path = str(tmp_path / "songs")
    old = {r.songId: r.item_index for r in recommend.train(first, "songId", path).index.collect()}
    grown = recommend.train(crowd, "songId", path, retrain=True)
    assert old.items() <= {r.songId: r.item_index for r in grown.index.collect()}.items()
    assert recommend.recommend(grown, crowd, 3).count() > 0


@pytest.mark.parametrize("block_items", [1, 4, 4_096])
@pytest.mark.parametrize("item", ["songId", "artistId"])
def test_unheard_is_everything_minus_heard(crowd, monkeypatch, block_items, item):
    monkeypatch.setattr(items, "BLOCK_ITEMS", block_items)
    heard = {(r.user_id, r[item]) for r in crowd.select("user_id", item).collect()}
    every = {i for _, i in heard}
    expected = Counter((u, i) for u in {u for u, _ in heard} for i in every if (u, i) not in heard)
    found = items.unheard_items(crowd, item)
    assert Counter((r.user_id, r[item]) for r in found.collect()) == expected
    some = items.unheard_items(crowd, item, [2, 5, 999])
    assert Counter((r.user_id, r[item]) for r in some.collect()) == Counter(p for p in expected if p[0] in (2, 5))


@pytest.mark.parametrize("item", ["songId", "artistId"])
def test_unheard_ranges_are_bounded_by_what_was_heard(crowd, item):
    index = items.item_index(crowd, item)
    ranges = items.unheard_ranges(crowd, item, index=index).collect()
    numbers = {r[item]: r.item_index for r in index.collect()}
    heard = {}
    for r in crowd.select("user_id", item).distinct().collect():
        heard.setdefault(r.user_id, set()).add(numbers[r[item]])
    for user, mine in heard.items():
        runs = sorted((r.low, r.high) for r in ranges if r.user_id == user)
        assert len(runs) <= len(mine) + 1
        assert [at for low, high in runs for at in range(low, high + 1)] == [at for at in range(len(numbers)) if at not in mine]
        assert all(high + 1 < low for (_, high), (low, _) in zip(runs, runs[1:]))
    assert {r.user_id for r in items.unheard_ranges(crowd, item, [2, 999]).collect()} <= {2}


def test_dimensions_take_the_latest_name(make_plays):
    plays = make_plays([("user_1", 5, "a", "s"), ("user_2", 9, "a", "s"), ("user_2", 1, "b", "s")])
    plays = plays.withColumn("artist", F.concat("artist", F.lit(" at "), "ts_ms"))
    assert {(r.artistId, r.artist) for r in items.artist_dimension(plays).collect()} == {
        ("a", "name of a at 9"),
        ("b", "name of b at 1"),
    }
    assert [tuple(r) for r in items.song_dimension(plays).collect()] == [("s", "a", "name of a at 9", "name of s")]


def test_ratings_count_every_play(plays):
    assert items.song_ratings(plays).agg(F.sum("play_count")).first()[0] == plays.count()


def test_users_are_numbers_not_names(spark, make_plays):
    plays = make_plays([("user_000001", 5, "a", "s1"), ("user_00001", 9, "a", "s2"), ("user_000002", 1, "b", "s3")])
    assert sorted(numbers_of(spark, ["user_00001", "user_1", "user_2"])) == [1, 2]
    assert {(r.user_id, r.songId) for r in last_play_by_user(plays).collect()} == {(1, "s2"), (2, "s3")}
    assert [r.songId for r in last_play_by_user(plays, [1]).collect()] == ["s2"]
    assert last_play_by_user(plays, [77]).count() == 0
    table = spark.createDataFrame([(2,), (2,), (77,)], "user_id int")
    assert [r.songId for r in last_play_by_user(plays, table).collect()] == ["s3"]


def test_profile_join_keeps_every_play_once(plays, profiles):
    joined = plays_with_profile(plays, profiles)
    assert joined.count() == plays.count()
    seen = {(r.user_id, r.gender, r.age, r.country, r.gender_id) for r in joined.collect()}
    assert seen == {(1, "m", 30, "Peru", 1), (2, "F", 0, "Japan", 2), (3, None, 0, None, 0)}


def test_split_is_repeatable_and_close_to_the_share(spark, plays):
    rows = spark.range(10_000).withColumnRenamed("id", "event_id")
    share = with_split(rows).filter("is_train").count()
    assert share == 6053
    once = sorted(with_split(plays).select("user", "ts_ms", "songId", "is_train").collect())
    assert once == sorted(with_split(plays.repartition(3)).select("user", "ts_ms", "songId", "is_train").collect())
    assert sum(part.count() for part in random_split(plays)) == plays.count()


def closed_form(examples, label, features):
    """Naive Bayes by numpy over collected examples; returns a function from row to label."""
    totals, counts = {}, Counter()
    for row in examples:
        name = str(row[label])
        counts[name] += 1
        totals[name] = totals.get(name, np.zeros(len(features))) + np.array([float(row[f]) for f in features])
    names = sorted(totals)
    priors = np.log([counts[n] + 1 for n in names]) - np.log(sum(counts.values()) + len(names))
    sums = np.array([totals[n] for n in names])
    weights = np.log(sums + 1) - np.log(sums.sum(axis=1, keepdims=True) + len(features))
    return lambda row: names[int(np.argmax(priors + weights @ np.array([float(row[f]) for f in features])))]


@pytest.mark.parametrize("block_classes", [bayes.BLOCK_CLASSES, 4])
def test_next_song_equals_the_closed_form(monkeypatch, plays, profiles, block_classes):
    monkeypatch.setattr(bayes, "BLOCK_CLASSES", block_classes)
    examples = next_song.split_examples(plays, profiles)
    model = next_song.train_on(examples)
    rows = examples.collect()
    pick = closed_form([r for r in rows if r.is_train], "next_songId", next_song.FEATURES)
    test = [r for r in rows if not r.is_train]
    predicted = bayes.predict(model, examples.filter("NOT is_train"), next_song.FEATURES).collect()
    assert Counter(r.predicted_label for r in predicted) == Counter(pick(r) for r in test)
    score = next_song.holdout_accuracy(model, next_song.counted_examples(plays, profiles)).first()
    assert (score.correct, score.total) == (sum(pick(r) == r.next_songId for r in test), len(test))
    answers = {r.user_id: r.songId for r in next_song.predict(model, plays, profiles).collect()}
    last = plays_with_profile(last_play_by_user(plays), profiles).collect()
    assert answers == {r.user_id: pick(r) for r in last}
    assert next_song.predict(model, plays, profiles, [12345]).count() == 0


@pytest.mark.parametrize("split_classes", [bayes.SPLIT_CLASSES, 60])
def test_blocks_that_cannot_win_are_not_visited(spark, monkeypatch, split_classes):
    """Many classes over three features: the labels of all pairs from a small part of them."""
    monkeypatch.setattr(bayes, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(bayes, "SPLIT_CLASSES", split_classes)
    monkeypatch.setattr(bayes, "BLOCK_POINTS", 5)
    rng = np.random.default_rng(2)
    features = ["a", "b", "c"]
    rows = [(f"{k:04d}", int(rng.integers(1, 4)), *map(float, rng.integers(0, (900, 7, 24)))) for k in range(400)]
    rows += [(f"{k + 400:04d}", *rows[k][1:]) for k in range(50)]
    totals = spark.createDataFrame(rows, "label string, n bigint, a double, b double, c double")
    points = [tuple(map(float, rng.integers(0, (900, 7, 24)))) for _ in range(200)] + [(0.0, 0.0, 0.0)] * 3
    asked = spark.createDataFrame([(at, *point) for at, point in enumerate(points)], "at int, a double, b double, c double")
    model = bayes.train(totals, features)
    n, sums = np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
    priors = np.log(n + 1) - np.log(n.sum() + len(n))
    weights = np.log(sums + 1) - np.log(sums.sum(axis=1, keepdims=True) + 3)
    found = {r.at: r.predicted_label for r in bayes.predict(model, asked, features).collect()}
    for at, point in enumerate(points):
        scores = priors + weights @ np.array(point)
        best = [k for k in range(len(rows)) if scores[k] > scores.max() - 1e-9]
        assert int(found[at]) in best and (len(best) > 1 or int(found[at]) == best[0])
    report = bayes.visits(model, asked, features).first()
    assert report.points == len(set(points)) and report.blocks > 40
    assert report.visits < 0.35 * report.points * report.blocks


@pytest.mark.parametrize("bucket_ms, forward", [(1, False), (60_000, True), (next_time.HOUR_MS, True)])
def test_next_time_equals_the_closed_form(plays, bucket_ms, forward):
    examples = next_time.split_examples(plays, bucket_ms, forward)
    model = next_time.train_on(examples)
    training = [r for r in examples.collect() if r.is_train]
    pick = closed_form(training, "bucket", next_time.FEATURES)
    for last in last_play_by_user(plays).collect():
        [answer] = next_time.predict(model, plays, [last.user_id]).collect()
        gaps = [r.gap_ms for r in training if str(r.bucket) == pick(last)]
        assert answer.predicted_gap_ms == int(np.median(gaps))
        assert answer.predicted_ts >= answer.last_ts
        assert (answer.predicted_ts - answer.last_ts).total_seconds() * 1000 == pytest.approx(answer.predicted_gap_ms)


@pytest.mark.parametrize("sorted_gaps, cells", [(10**6, 2), (0, 2), (0, 7), (0, 1_024)])
def test_medians_sorted_and_closed_in(spark, monkeypatch, sorted_gaps, cells):
    monkeypatch.setattr(next_time, "SORTED_GAPS", sorted_gaps)
    monkeypatch.setattr(next_time, "CELLS", cells)
    rng = random.Random(6)
    gaps = {"hot": Counter(rng.choices([0, 5, 6, 7, 1000, 3_599_999, 10**15], k=999)), "one": Counter([77]), "two": Counter([1, 10**9])}
    gaps |= {f"b{at}": Counter(rng.randrange(10**6) for _ in range(rng.randint(1, 40))) for at in range(12)}
    rows = [(bucket, gap, n) for bucket, found in gaps.items() for gap, n in found.items()]
    medians = next_time.median_gaps(spark.createDataFrame(rows, "bucket string, gap_ms bigint, n bigint"))
    expected = {bucket: int(np.median(sorted(found.elements()))) for bucket, found in gaps.items()}
    assert {r.predicted_label: r.predicted_gap_ms for r in medians.collect()} == expected


def test_training_without_examples_is_an_error(plays):
    with pytest.raises(ValueError, match="no training examples"):
        next_time.train(plays.limit(0))


def test_linear_model_is_least_squares(plays):
    rows = next_time.forward_gap_examples(plays).collect()
    x = np.array([[r.user_id, r.day_of_week, r.hour_of_day, 1.0] for r in rows])
    y = np.array([r.gap_ms for r in rows], dtype=float)
    solution, *_ = np.linalg.lstsq(x, y, rcond=None)
    model = next_time.train_linear(plays)
    assert [*model.coefficients, model.intercept] == pytest.approx(solution, rel=1e-6)
    mse = next_time.linear_mse(model, plays).first().mse
    assert mse == pytest.approx(np.mean((x @ solution - y) ** 2), rel=1e-6)


@pytest.mark.parametrize("item", ["songId", "artistId"])
def test_recommendations_are_the_best_unheard_items(crowd, item):
    n = 4
    model = recommend.train(crowd, item)
    found = recommend.recommend(model, crowd, n).collect()
    candidates = items.unheard_items(crowd, item).join(model.index, item)
    scored = model.als.transform(candidates).collect()
    for user in range(1, 41):
        scores = sorted((r.prediction for r in scored if r.user_id == user), reverse=True)[:n]
        mine = sorted((r for r in found if r.user_id == user), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(scores) + 1))
        assert [r.score for r in mine] == pytest.approx(scores, rel=1e-5)
        allowed = {r[item] for r in scored if r.user_id == user}
        assert {r[item] for r in mine} <= allowed
    some = recommend.recommend(model, crowd, n, [5, 999]).collect()
    assert sorted(some) == sorted(r for r in found if r.user_id == 5)
    assert recommend.recommend(model, crowd, n, [999]).collect() == []


@pytest.mark.parametrize("chunk_items, item_block", [(1_000, 4), (12, 3), (5, 2)])
def test_recommendations_by_falling_length_are_those_of_all_pairs(monkeypatch, crowd, chunk_items, item_block):
    model = recommend.train(crowd, "songId")
    expected = sorted(recommend.recommend(model, crowd, 3).collect())
    monkeypatch.setattr(recommend, "CHUNK_ITEMS", chunk_items)
    monkeypatch.setattr(recommend, "ITEM_BLOCK", item_block)
    monkeypatch.setattr(recommend, "USER_BLOCK", 7)
    assert sorted(recommend.recommend(model, crowd, 3).collect()) == expected


def test_long_tails_of_items_are_not_visited(spark, monkeypatch):
    """500 items of falling lengths: users see few blocks, and every answer is that of all pairs."""
    rng = np.random.default_rng(5)
    factors = rng.standard_normal((500, recommend.RANK)) / (1 + np.arange(500))[:, None] ** 0.7
    people = rng.standard_normal((60, recommend.RANK))
    factors[100:104] = factors[100]  # ties, by id

    class Trained:
        itemFactors = spark.createDataFrame([(i, [float(x) for x in f]) for i, f in enumerate(factors)], "id int, features array<float>")
        userFactors = spark.createDataFrame([(u, [float(x) for x in f]) for u, f in enumerate(people)], "id int, features array<float>")

    index = spark.createDataFrame([(f"item {i * 7 % 500:03d}", i) for i in range(500)], "songId string, item_index int")
    heard = [(u, f"item {i:03d}") for u in range(60) for i in rng.choice(500, 20, replace=False)]
    plays = spark.createDataFrame([(u, i) for u, i in heard] + [(0, "not in the model")], "user_id int, songId string")
    model = recommend.Recommender(Trained, index, "songId")
    scores = (people.astype(np.float32).astype(float) @ factors.astype(np.float32).astype(float).T).astype(np.float32)
    expected = set()
    for u in range(60):
        known = {item for user, item in heard if user == u}
        best = sorted((-scores[u, i], f"item {i * 7 % 500:03d}") for i in range(500) if f"item {i * 7 % 500:03d}" not in known)
        expected |= {(u, rank + 1, float(-score), item) for rank, (score, item) in enumerate(best[:4])}
    monkeypatch.setattr(recommend, "ITEM_BLOCK", 10)
    for chunk_items in (1_000, 100):
        monkeypatch.setattr(recommend, "CHUNK_ITEMS", chunk_items)
        assert {tuple(r) for r in recommend.recommend(model, plays, 4).collect()} == expected
        visited = [r.visited for r in recommend.visited_blocks(model, plays, 4).collect()]
        assert len(visited) == 60 and max(visited) <= 60 and sum(visited) < 0.6 * 60 * 50


def test_users_newer_than_the_model_are_folded_in(crowd, make_plays):
    model = recommend.train(crowd, "songId")
    songs = sorted(r.songId for r in model.index.collect())
    rows = [("user_000100", at, "art", song) for at, song in enumerate(songs[:6] + songs[:3])]
    rows += [("user_000101", 1, "art", "song of nobody else"), ("user_000102", 1, "art", songs[9])]
    log = crowd.unionByName(make_plays(rows))
    factors = {r.id: np.array(r.features, dtype=float) for r in model.als.itemFactors.collect()}
    number = {r.songId: r.item_index for r in model.index.collect()}
    found = recommend.recommend(model, log, 5).collect()
    for user, counts in ((100, {s: 2 if at < 3 else 1 for at, s in enumerate(songs[:6])}), (101, {}), (102, {songs[9]: 1})):
        x = np.array([factors[number[s]] for s in counts]).reshape(-1, recommend.RANK)
        left = x.T @ x + recommend.REGULARIZATION * len(counts) * np.eye(recommend.RANK)
        solved = np.linalg.solve(left, x.T @ np.array(list(counts.values()))) if counts else np.zeros(recommend.RANK)
        best = sorted((-float(factors[number[s]] @ solved), s) for s in songs if s not in counts)[:5]
        mine = sorted((r for r in found if r.user_id == user), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [r.score for r in mine] == pytest.approx([-score for score, _ in best], rel=1e-4, abs=1e-6)
    assert [r.songId for r in found if r.user_id == 101] == songs[:5]
    assert sorted(r for r in found if r.user_id < 100) == sorted(recommend.recommend(model, crowd, 5).collect())


def test_a_play_after_training_removes_its_item(spark, crowd, make_plays):
    model = recommend.train(crowd, "songId")
    best = {r.user_id: r for r in recommend.recommend(model, crowd, 1).collect()}
    user = min(best)
    again = make_plays([(f"user_{user:06d}", 2_000_000_000_000, "art", best[user].songId)])
    after = recommend.recommend(model, crowd.unionByName(again), 1, [user]).collect()
    assert [r.songId for r in after] != [best[user].songId]


def test_factors_do_not_depend_on_the_session(spark, crowd):
    before, answers = spark.conf.get("spark.sql.shuffle.partitions"), []
    for width in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        answers.append(sorted(recommend.recommend(recommend.train(crowd, "songId"), crowd, 3).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert answers[0] == answers[1]


def test_user_factors_solve_their_normal_equations(crowd):
    """ALS ends with the users' step: each factor is the regularised fit to the item factors."""
    model = recommend.train(crowd, "songId")
    index = {r.songId: r.item_index for r in model.index.collect()}
    items_ = {r.id: np.array(r.features) for r in model.als.itemFactors.collect()}
    users_ = {r.id: np.array(r.features) for r in model.als.userFactors.collect()}
    counts = {}
    for r in crowd.groupBy("user_id", "songId").count().collect():
        counts.setdefault(r.user_id, []).append((index[r.songId], r["count"]))
    errors = []
    for user, rated in counts.items():
        x = np.array([items_[i] for i, _ in rated])
        y = np.array([n for _, n in rated], dtype=float)
        left = x.T @ x + recommend.REGULARIZATION * len(rated) * np.eye(recommend.RANK)
        solution = np.linalg.solve(left, x.T @ y)
        errors.append(np.abs(x @ solution - x @ users_[user]).max() / (1 + np.abs(y).max()))
    items_too = {}
    for user, rated in counts.items():
        for i, n in rated:
            items_too.setdefault(i, []).append((user, n))
    item_errors = []
    for item, rated in items_too.items():
        x = np.array([users_[u] for u, _ in rated])
        y = np.array([n for _, n in rated], dtype=float)
        left = x.T @ x + recommend.REGULARIZATION * len(rated) * np.eye(recommend.RANK)
        item_errors.append(np.abs(x @ np.linalg.solve(left, x.T @ y) - x @ items_[item]).max() / (1 + np.abs(y).max()))
    assert min(max(errors), max(item_errors)) < 1e-3


def test_models_of_other_parameters_are_replaced(spark, plays, profiles, crowd, tmp_path):
    path = str(tmp_path / "time")
    exact = next_time.train(plays, path, bucket_ms=1, forward=False)
    hourly = next_time.train(plays, path)
    assert exact.medians.count() != 0 and store.kept_parameters(spark, path)["bucket_ms"] == next_time.HOUR_MS
    assert sorted(hourly.medians.collect()) == sorted(next_time.train(plays).medians.collect())
    path = str(tmp_path / "items")
    recommend.train(crowd, "songId", path)
    assert "artistId" in recommend.train(crowd, "artistId", path).index.columns
    assert recommend.train(crowd, "artistId", path, blocks=3).als.rank == recommend.RANK
    assert store.kept_parameters(spark, path)["blocks"] == 3
    next_song.train(plays, profiles, path)
    assert store.kept_parameters(spark, path)["kind"] == "next_song"


def test_models_are_kept_and_replaced(spark, plays, tmp_path):
    path, trained = str(tmp_path / "model"), []

    def fit():
        trained.append(1)
        return next_time.train(plays)

    def get(retrain=False):
        return store.load_or_train(spark, path, {"a": 1}, fit, next_time._save, lambda s, p: p, retrain)

    get()
    first = get()
    assert first.startswith(path) and len(trained) == 1
    get(retrain=True)
    assert len(trained) == 2
    second = get()
    assert second != first and [kept["version"] for kept in store.kept_versions(spark, path)] == [1, 2]
    for folder in (first, second):  # a reader of the old version goes on
        assert spark.read.parquet(f"{folder}/medians").count() > 0


@pytest.mark.parametrize("had_one", [False, True])
def test_a_save_cut_short_is_not_a_model(spark, tmp_path, had_one):
    path = str(tmp_path / "model")

    def keeps(model, target):
        spark.range(1).write.parquet(f"{target}/part")

    def fails(model, target):
        raise OSError("disk full")

    if had_one:
        store.load_or_train(spark, path, {}, lambda: 1, keeps, lambda s, p: 2)
        assert store.kept_parameters(spark, path) == {}
    with pytest.raises(OSError):
        store.load_or_train(spark, path, {}, lambda: 1, fails, lambda s, p: 2, retrain=True)
    assert store.kept_parameters(spark, path) == ({} if had_one else None)
    if had_one:  # the version before stays in use
        assert store.load_or_train(spark, path, {}, None, fails, lambda s, p: s.read.parquet(f"{p}/part").count()) == 1


def test_a_changed_log_is_reported(spark, crowd, profiles, make_plays, tmp_path):
    raw = crowd.select("user", "ts", "ts_ms", "artistId", "artist", "songId", "song")
    models = str(tmp_path / "models")
    ListeningLog(raw, profiles, model_dir=models).predict_next_play_time("user_5").collect()
    same = ListeningLog(raw.repartition(3), profiles, model_dir=models)
    n = crowd.count()
    assert [tuple(r) for r in same.changed_models().collect()] == [("next_time", 1, n, n, False)]
    more = make_plays([("user_000005", 9_000_000, "art", "song")]).select(*raw.columns)
    grown = ListeningLog(raw.unionByName(more), profiles, model_dir=models)
    assert [tuple(r) for r in grown.changed_models().collect()] == [("next_time", 1, n, n + 1, True)]
    assert ListeningLog(raw, profiles).changed_models().collect() == []


def test_all_questions_with_stored_models(crowd, profiles, tmp_path):
    raw = crowd.select("user", "ts", "ts_ms", "artistId", "artist", "songId", "song")
    first = ListeningLog(raw, profiles, model_dir=str(tmp_path / "models"))
    second = ListeningLog(raw, profiles, model_dir=str(tmp_path / "models"))
    for ask in (
        lambda log: log.predict_next_song(["user_5", "user_000006"]),
        lambda log: log.predict_next_play_time("user_00005"),
        lambda log: log.recommend_songs(3, "user_5"),
        lambda log: log.recommend_artists(3, "user_5"),
    ):
        answer = sorted(ask(first).collect())
        assert answer and answer == sorted(ask(second).collect())
    nested = first.recommend(3).collect()
    assert {r.user_id for r in nested} == set(range(1, 41)) - {1}
    assert all(len(r.songs) <= 3 for r in nested)
    [mine] = first.recommend(3, "user_5").collect()
    ranked = sorted(first.recommend_songs(3, "user_5").collect(), key=lambda r: r.rank)
    assert [s.songId for s in mine.songs] == [r.songId for r in ranked]
    first.register_views()
    assert first.spark.table("plays").count() == crowd.count()
    assert first.spark.table("profiles").count() == 3
    assert first.top_users(1).first().userName == "user_000001"
    assert first.top_songs(30).agg(F.sum("playCount")).first()[0] == crowd.count()
    assert first.top_sessions(2).select("user", "sessionId").distinct().count() == 2


def test_stored_song_models(spark, plays, profiles, tmp_path):
    path = str(tmp_path / "model")
    model = next_song.train(plays, profiles, path)
    again = next_song.train(plays, profiles, path)
    assert sorted(next_song.predict(model, plays, profiles).collect()) == sorted(
        next_song.predict(again, plays, profiles).collect()
    )
