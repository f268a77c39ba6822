"""Duplicates, replacement, snapshots, refresh, the change stream, and the entry points."""

import hashlib
import math
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from stylescout.operators import duplicates as D
from stylescout.operators import index as I
from stylescout.operators import replace as R
from stylescout.operators import search as S
from stylescout.operators.index import cap_locations, file_classes
from stylescout.plans import catalog
from stylescout.plans.shared import drop_stored, small, spread, stored
from stylescout.sources import corpus as C
from stylescout.sources import snapshot as P
from stylescout.streaming import index_stream as X


def sources_of(spark, files):
    return spark.createDataFrame([(f, s, 1) for f, s in files.items()], "file string, source string, mtime_ms bigint")


def test_duplicates(spark):
    same = '<i className="a b c d" />'
    files = {"1": same, "2": '<i className="d c b a" />', "3": '<i className="a" />', "4": same.replace("a", "z") + ";\n" + same.replace("a", "z")}
    places = C.extract_classes(sources_of(spark, files))
    sets, contexts = D.repeated_sets(cap_locations(places)), places.select("file", "line", "context").distinct()
    groups = D.duplicate_groups(sets)
    assert [(r["classes"], r["n_occurrences"], r["n_files"]) for r in groups.collect()] == [(["a", "b", "c", "d"], 2, 2)]
    assert sorted(r["file"] for r in D.duplicate_occurrences(sets, groups, contexts).collect()) == ["1", "2"]
    shown = D.occurrence_report(sets, groups, contexts).orderBy("file").collect()
    assert [(r["label"], r["context"]) for r in shown] == [("1:1", files["1"]), ("2:1", files["2"])]
    every = D.line_class_sets(cap_locations(places))
    assert D.duplicate_groups(every).collect() == groups.collect() and every.count() == 2
    assert D.duplicate_summary(groups, sets).first()["files"] == "1, 2"


def test_hot_groups_stay_in_chunks(spark, monkeypatch):
    """Files of a hot class and a hot set lie in several rows of bounded size, which hold them all; the digest is that of all."""
    monkeypatch.setattr(I, "CHUNK_FILES", 10)
    names = [f"f{i}" for i in range(95)]
    rows = spark.createDataFrame([(f, "hot") for f in names] + [("f1", "cold")], "file string, class string")
    posted = I.class_postings(rows).orderBy("chunk").collect()
    assert max(len(r["files"]) for r in posted) <= 10
    assert [f for r in posted if r["class"] == "hot" for f in r["files"]] == sorted(names)
    counts = {r["class"]: tuple(r)[1:] for r in I.class_counts(rows).collect()}
    assert counts == {"hot": (95, "f0", "f94"), "cold": (1, "f1", "f1")}
    same = '<i className="a b c" />'
    sets = D.line_class_sets(cap_locations(C.extract_classes(sources_of(spark, {f: same for f in names} | {x: same.replace("a ", "z ") for x in "xy"}))))
    summary = D.duplicate_summary(D.duplicate_groups(sets), sets)
    assert max(r["files"].count(",") for r in summary.collect()) < 10
    got = {tuple(r["classes"]): r["files_md5"] for r in D.files_md5(summary).collect()}
    md5 = lambda files: hashlib.md5(", ".join(sorted(files)).encode()).hexdigest()
    assert got == {("a", "b", "c"): md5(names), ("b", "c", "z"): md5("xy")}


@pytest.mark.parametrize(
    ("value", "targets", "new", "want"),
    [
        ("a bg-red b", ["bg-red"], ["bg-blue"], "a bg-blue b"), ("A x a", ["a"], ["q", "r"], "q r x"), (" a  b ", ["a"], [], " b "),
        ("a", ["a"], [], ""), ("a  b", ["c"], ["d"], "a  b"), ("  ", ["a"], ["b"], "  "),
    ],
)
def test_replace_in_string(spark, value, targets, new, want):
    row = spark.createDataFrame([(value, targets, new)], "v string, t array<string>, n array<string>")
    assert row.select(R.replace_in_string(F.col("v"), F.col("t"), F.col("n")).alias("r")).first()["r"]["new_value"] == want


def test_replacement(spark):
    files = {
        "a.tsx": '<i className="p-1 red p-2" />;\nconst k = cn(on ? "red" : "x"); <b className={k} />',
        "b.tsx": "<i className={`red ${on && 'red y'}`} />",
        "c.tsx": '<i className="blue" />',
    }
    sources = sources_of(spark, files)
    requests = spark.createDataFrame([(1, ["RED"], ["blue"])], "request_id bigint, targets array<string>, replacements array<string>")
    candidates = R.candidate_files(file_classes(C.extract_classes(sources)), requests)
    assert sorted(r["file"] for r in candidates.collect()) == ["a.tsx", "b.tsx"]
    edits = R.compute_edits(sources, requests, candidates)
    done = {r["file"]: r["source"] for r in R.apply_edits(sources, edits).collect()}
    assert done == {
        "a.tsx": '<i className="p-1 blue p-2" />;\nconst k = cn(on ? "blue" : "x"); <b className={k} />',
        "b.tsx": "<i className={`blue ${on && 'blue y'}`} />",
    }
    preview = R.preview_replacements(edits)
    keys = [r["key"] for r in preview.orderBy("file", "start").collect()]
    assert len(set(keys)) == 4
    assert R.apply_selected(preview, preview.select("key").limit(0))[0].count() == 0
    changed = sources_of(spark, files | {"b.tsx": "\n" + files["b.tsx"]})
    now = R.preview_replacements(R.compute_edits(changed, requests, candidates))
    kept, skipped = R.apply_selected(now, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert (kept.count(), skipped.first()["skipped"]) == (2, 2)


def test_snapshot_and_refresh(spark, tmp_path):
    old = sources_of(spark, {"a": '<i className="x" />', "b": '<i className="y" />', "c": '<i className="z" />'})
    path = str(tmp_path / "index")
    C.save_index(C.extract_classes(old), old, path)
    assert C.load_index(spark, path, include="other") is None
    now = spark.createDataFrame([("a", '<i className="x" />', 1), ("b", '<i className="new" />', 2), ("d", '<i className="d" />', 1)], "file string, source string, mtime_ms bigint")
    got = C.refresh(C.load_index(spark, path), now)
    full = C.extract_classes(now)
    assert sorted((r["file"], r["class"]) for r in got.collect()) == sorted((r["file"], r["class"]) for r in full.collect())


def test_refresh_locations_takes_all_events(spark, data):
    """The registered refresh ends at the last state of all events, and tells kept, new and removed files apart."""
    events = spark.read.parquet(f"{data}/events.parquet").collect()
    ms = lambda e: round((e["ts"] - datetime(1970, 1, 1)) / timedelta(milliseconds=1) - 0.4999)
    times = sorted(map(ms, events))
    at = 0.98 * (len(times) - 1)
    cut = times[math.floor(at)] + (at - math.floor(at)) * (times[math.ceil(at)] - times[math.floor(at)])

    def listing(rows):
        last = {}
        for e in sorted(rows, key=lambda e: (e["ts"], e["event_id"])):
            last[f"user/{e['user_id']}.tsx"] = e
        return {f: e for f, e in last.items() if e["event_type"] != "error"}

    old, now, want = listing(e for e in events if ms(e) <= cut), listing(events), set()
    for f in old.keys() | now.keys():
        if f not in now:
            want.add((f, "removed", None, None))
            continue
        e = now[f]
        status = "unchanged" if f in old and ms(old[f]) >= ms(e) else "extract"
        want |= {(f, status, c, ms(e)) for c in (e["event_type"], f"w-[{math.floor(e['value'])}px]")}
    got = entry_points.queries()["refresh_locations"](spark, data).collect()
    assert {s for _, s, _, _ in want} == {"removed", "unchanged", "extract"}
    assert {e["event_type"] for e in now.values()} == {"view", "click", "signup", "purchase"}
    assert len(got) == len(want)
    assert {(r["file"], r["status"], r["class"], r["mtime_ms"]) for r in got} == want


def test_scan_files(spark, tmp_path):
    """Directories are left out below the root only: the root itself may lie in one that is called so."""
    root = tmp_path / "build" / "corpus"
    for name in ("a.tsx", "sub/b.js", "node_modules/c.ts", "sub/dist/e.ts", "d.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("é")
    for path in (str(root), f"file://{root}/"):
        got = C.scan_corpus(spark, path).collect()
        assert sorted(r["file"].rsplit("/", 1)[1] for r in got) == ["a.tsx", "b.js"]
        assert {r["source"] for r in got} == {"é"}
    assert C.scan_corpus(spark, str(root), exclude=()).count() == 4


def _changes(spark, rows):
    schema = "file string, op string, source string, mtime_ms bigint, event_ts timestamp, seq bigint"
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(f, op, s, ms, at + timedelta(seconds=ms), ms) for f, op, s, ms in rows], schema)


def test_stream_merge(spark, tmp_path):
    """Late, repeated and deleted events: none brings back what a newer one has replaced or deleted."""
    path = str(tmp_path / "snap")
    X.create_snapshot(spark, path)
    say = lambda c: f'<i className="{c}" />'
    now = lambda: sorted((r["file"], r["class"]) for r in C.load_index(spark, path).collect())
    batches = [
        [("a", "upsert", say("x"), 1), ("a", "upsert", say("y"), 2), ("b", "upsert", say("z"), 1), ("c", "upsert", say("gone"), 1)],
        [("a", "upsert", say("old"), 1), ("b", "delete", None, 5), ("dist/q", "upsert", say("no"), 9), ("c", "upsert", "no classes", 4)],
        [("a", "upsert", say("old"), 1), ("b", "delete", None, 5)],
        [("b", "upsert", say("stale"), 3), ("c", "upsert", say("stale"), 3)],
    ]
    for rows in batches:
        X.apply_batch(_changes(spark, rows), path)
    assert now() == [("a", "y")]
    X.apply_batch(_changes(spark, batches[1]), path)
    assert now() == [("a", "y")]
    X.apply_batch(_changes(spark, [("b", "upsert", say("back"), 6), ("d", "upsert", "(", 1)]), path)
    assert now() == [("a", "y"), ("b", "back")]
    marks = sorted((r["file"], r["mtime_ms"], r["deleted"]) for r in P.read_snapshot(spark, path).filter("class is null").collect())
    assert marks == [("c", 4, False), ("d", 1, False)]
    states = P.read_snapshot(spark, path).collect()
    assert P.compact(spark, path) and len(P.log(spark, path)) == 1
    assert sorted(map(str, P.read_snapshot(spark, path).collect())) == sorted(map(str, states))


def test_failed_commit_is_not_read(spark, tmp_path):
    """Data that no commit names is not read, nor is a log entry that is not written in full; the next commit is."""
    path = str(tmp_path / "snap")
    X.create_snapshot(spark, path)
    X.apply_batch(_changes(spark, [("a", "upsert", '<i className="one" />', 1)]), path)
    P.read_snapshot(spark, path).withColumn("class", F.lit("half")).write.parquet(f"{path}/data/folder=half")
    (tmp_path / "snap" / "log" / "000000000009.json").write_text('{"version": 9, "fold')
    assert [r["class"] for r in C.load_index(spark, path).collect()] == ["one"]
    X.apply_batch(_changes(spark, [("a", "upsert", '<i className="two" />', 2)]), path)
    assert [r["class"] for r in C.load_index(spark, path).collect()] == ["two"]


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two commits behind one version, the second fails as a whole; a batch that is overtaken is merged again, and loses nothing."""
    path = str(tmp_path / "snap")
    X.create_snapshot(spark, path)
    say = lambda f, c, ms: _changes(spark, [(f, "upsert", f'<i className="{c}" />', ms)])
    now = lambda: sorted((r["file"], r["class"]) for r in C.load_index(spark, path).collect())
    X.apply_batch(say("a", "one", 1), path)
    at, rows = P.version(spark, path), stored(P.read_snapshot(spark, path).withColumn("class", F.lit("late")))
    X.apply_batch(say("b", "two", 1), path)
    with pytest.raises(P.Conflict):
        P.commit(rows, path, at)
    assert now() == [("a", "one"), ("b", "two")]
    merge, seen = X.merge_changes, []

    def overtaken(*args):
        out = merge(*args)
        if not seen:
            seen.append(1)
            X.apply_batch(say("a", "newer", 9), path)
        return out

    monkeypatch.setattr(X, "merge_changes", overtaken)
    X.apply_batch(_changes(spark, [("a", "upsert", '<i className="older" />', 5), ("c", "upsert", '<i className="three" />', 5)]), path)
    assert now() == [("a", "newer"), ("b", "two"), ("c", "three")]


def test_old_versions_are_removed(spark, tmp_path):
    """Compaction by writers bounds what is merged; removal keeps the last state, and all that writers may still be at work on."""
    path = str(tmp_path / "snap")
    X.create_snapshot(spark, path)
    for i in range(P.MOST_DELTAS + 2):
        row = (f"f{i % 3}", f"c{i}", 1, 0, 0, None, i, False)
        P.commit(spark.createDataFrame([row], P.SNAPSHOT), path, P.version(spark, path))
    assert P.compact(spark, path, P.MOST_DELTAS) and not P.compact(spark, path, P.MOST_DELTAS)
    (tmp_path / "snap" / "data" / "folder=unfinished").mkdir()
    state = sorted(map(str, P.read_snapshot(spark, path).collect()))
    assert [r["class"] for r in P.read_snapshot(spark, path).orderBy("class").collect()] == ["c15", "c16", "c17"]
    assert P.remove_old(spark, path) == P.MOST_DELTAS + 2
    assert sorted(map(str, P.read_snapshot(spark, path).collect())) == state
    assert P.remove_old(spark, path) == 0 and P.remove_old(spark, path, orphan_ms=-1) == 1
    assert sorted(map(str, P.read_snapshot(spark, path).collect())) == state and len(list((tmp_path / "snap" / "log").glob("*.json"))) == 1


def test_refresh_in_place(spark, tmp_path):
    """A refreshed snapshot equals a new one, writes only what has changed, and nothing where nothing has."""
    listing = lambda rows: spark.createDataFrame([(f, f'<i className="{c}" />' if c else "", ms) for f, c, ms in rows], "file string, source string, mtime_ms bigint")
    old = listing([(f"f{i}", f"c{i} d", 1) for i in range(40)])
    path = str(tmp_path / "index")
    C.save_index(C.extract_classes(old), old, path)
    now = listing([(f"f{i}", f"c{i} d", 1) for i in range(1, 38)] + [("f38", "new", 2), ("f39", None, 3), ("g", "g", 1)])
    C.refresh_index(spark, path, now)
    got = sorted((r["file"], r["class"], r["mtime_ms"]) for r in C.load_index(spark, path).collect())
    assert got == sorted([*((f"f{i}", c, 1) for i in range(1, 38) for c in (f"c{i}", "d")), ("f38", "new", 2), ("g", "g", 1)])
    last = P.log(spark, path)[-1]
    assert spark.read.parquet(f"{path}/data/folder={last['folder']}").select("file").distinct().count() == 4
    C.refresh_index(spark, path, now)
    assert P.version(spark, path) == last["version"]


def test_streamed_snapshot_is_searched(spark, tmp_path):
    """A snapshot kept by the stream equals one saved at once, and a search runs on it."""
    files = {"a.tsx": '<i className="p q r" />', "b.tsx": '<i className="p" />;\n<b className="q s" />', "c.tsx": '<i className="t" />'}
    sources = sources_of(spark, files)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    C.save_index(C.extract_classes(sources), sources, one)
    X.create_snapshot(spark, two)
    for f, s in files.items():
        X.apply_batch(_changes(spark, [(f, "upsert", s, 1)]), two)
    read = lambda p: sorted(map(tuple, C.load_index(spark, p).select("file", "class", "emit_seq", "line", "column", "context", "mtime_ms").collect()))
    assert read(one) == read(two)
    index = I.Index.build(sources, C.load_index(spark, two))
    found = S.search(index, spark.createDataFrame([(1, "p q r")], "query_id bigint, raw string")).orderBy("rank").collect()
    assert [(r["file"], r["matched_count"]) for r in found] == [("a.tsx", 3), ("b.tsx", 2)]


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    # a column of whole numbers with nulls comes as floats from one side
    text = lambda v: "NULL" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, data, name):
    with duckdb.connect() as con:
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = con.execute(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_stored_tables_are_dropped(spark):
    table = stored(spark.range(10))
    assert small(table).count() == 10 and small(spark.createDataFrame([("x" * 1000, ["y"] * 3)], "a string, b array<string>")).count() == 1
    drop_stored(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table.inputFiles()[0])


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 50)
    assert spread(many) is many


def test_entry(spark):
    assert len(entry_points.queries()) >= 52
    assert "search" in entry_points.oracle_sql()
