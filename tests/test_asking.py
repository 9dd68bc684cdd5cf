import json
import time
from collections import Counter

import pytest
from pyspark import InheritableThread

from greffe.operators import asking, classify


def prompts(spark, n):
    return spark.createDataFrame([(f"k{i:02}", f"p{i:02}", i + 1) for i in range(n)], "id string, prompt string, rang int").repartition(3)


def logging(folder, seconds=0.0, fails=()):
    """A classifier that writes a file for each call: when it began and ended."""
    folder.mkdir(exist_ok=True)
    path = str(folder)

    def ask(body):
        own, began = json.loads(body)["messages"][1]["content"], time.time()
        time.sleep(seconds)
        with open(f"{path}/{own}-{time.time_ns()}", "w") as f:
            json.dump([own, began, time.time()], f)
        if own in fails:
            raise classify.ClassifierError("http", "500")
        return '{"statut": "Isolé"}'

    return ask


def calls(folder):
    return [json.loads(p.read_text()) for p in folder.iterdir()]


def test_cancel_between_slices_and_resume(spark, tmp_path):
    ask = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 40), rows=5)
    model = logging(tmp_path / "log")
    first = ask.resume(model, lanes=2, on_slice=lambda done: ask.cancel() if done == 3 else None)
    assert first.state == "cancelled" and 15 <= first.answered <= 20 and first.answered + first.left == 40
    asked = {own for own, *_ in calls(tmp_path / "log")}
    assert asked == {f"p{i:02}" for i in range(len(asked))}  # in the order of ranks
    later = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 40), rows=5)  # another session of the same work
    assert later.resume(model, lanes=2) == asking.Outcome("done", 40, 0)
    assert set(Counter(own for own, *_ in calls(tmp_path / "log")).values()) == {1}  # none twice
    assert {r.id for r in later.answers().collect()} == {f"k{i:02}" for i in range(40)}
    assert later.resume(model) == asking.Outcome("done", 40, 0) and len(calls(tmp_path / "log")) == 40
    assert {r.statut for r in classify.verdicts(later.answers()).collect()} == {"Isolé"}


def test_cancel_now(spark, tmp_path):
    """Slices under way lose their answers, finished ones keep them."""
    ask = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 60), rows=4)
    model, found = logging(tmp_path / "log", 0.3), []
    run = InheritableThread(target=lambda: found.append(ask.resume(model, lanes=2)))
    run.start()
    while ask.answers().count() < 8:
        time.sleep(0.1)
    ask.cancel(now=True)
    run.join(60)
    assert found[0].state == "cancelled" and 8 <= found[0].answered < 60
    kept = {r.id for r in ask.answers().collect()}
    assert ask.resume(logging(tmp_path / "log"), lanes=3).state == "done"
    times = Counter(own for own, *_ in calls(tmp_path / "log"))
    assert len(times) == 60 and all(times[k.replace("k", "p")] == 1 for k in kept)
    assert sum(n - 1 for n in times.values()) <= 2 * 4


def test_lanes_bound_the_calls_under_way(spark, tmp_path):
    ask = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 24), rows=3)
    assert ask.resume(logging(tmp_path / "log", 0.1), classify.Options(pause_s=0.15), lanes=2).state == "done"
    edges = sorted([(b, 1) for _, b, _ in calls(tmp_path / "log")] + [(e, -1) for _, _, e in calls(tmp_path / "log")])
    at = most = 0
    for _, step in edges:
        at += step
        most = max(most, at)
    assert most == 2


def test_breaker_ends_all_lanes_and_what_was_not_asked_is_asked_later(spark, tmp_path):
    ask = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 30), rows=10)
    bad = ask.resume(logging(tmp_path / "log", fails={"p02", "p03"}), lanes=1)
    assert bad == asking.Outcome("broken", 4, 26)
    assert {r.id: r.erreur for r in ask.answers().collect()} == {"k00": None, "k01": None, "k02": "http: 500", "k03": "http: 500"}
    assert ask.resume(logging(tmp_path / "log"), lanes=2) == asking.Outcome("done", 30, 0)
    assert set(Counter(own for own, *_ in calls(tmp_path / "log")).values()) == {1}


def test_nothing_to_ask_and_errors(spark, tmp_path):
    ask = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 1).where("false"))
    assert ask.resume() == asking.Outcome("done", 0, 0)
    lost = asking.Asking(spark, str(tmp_path / "none"))
    with pytest.raises(Exception):
        lost.resume()


def test_a_slice_lists_its_own_folder(spark, tmp_path, monkeypatch):
    """Else every slice lists all slices, whose number grows with the rows."""
    ask = asking.Asking(spark, str(tmp_path / "a")).prepare(prompts(spark, 12), rows=3)
    read, paths = type(spark.read).parquet, []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **o: (paths.extend(p), read(self, *p, **o))[1])
    assert ask.resume(lanes=1).state == "done"
    whole = [p for p in paths if p.endswith(("/prompts", "/answers"))]
    assert sum("/slice=" in p for p in paths) == 4 and len(whole) == 6  # pending before (no answers yet) and after, and the count of answers: not once a slice
    assert ask.answers().count() == 12
