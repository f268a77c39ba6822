"""The reader of sources, the resolution of what it states, and the extraction of class locations."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stylescout.functions.scanner import ScanError, places, scan
from stylescout.operators.index import cap_locations
from stylescout.plans.forms import FORMS
from stylescout.plans.shared import stored
from stylescout.sources.corpus import LEAVES, extract, extract_classes, extract_errors, resolve, scan_sources


def test_forms(spark):
    """Every form of expression, with its classes in their order."""
    sources = spark.createDataFrame([(str(k), source.replace("{n}", "7")) for k, (source, _) in enumerate(FORMS)], "file string, source string")
    found, errors = extract(sources)
    got = {}
    for r in found.orderBy("emit_seq").collect():
        got.setdefault(int(r["file"]), []).append((r["class"], r["line"]))
    for k, (source, want) in enumerate(FORMS):
        assert got.get(k, []) == [(c.replace("{n}", "7"), line) for c, line in want], source
    broken = ('cn("x-{n}"', r'cn("\u{110000}", "x-{n}")')
    assert sorted(r["file"] for r in errors.collect()) == sorted(str(k) for k, (source, _) in enumerate(FORMS) if source in broken)


def test_editing_takes_nested_expressions_and_values(spark):
    sources = {
        "list": 'const l = [<b className="no"/>, "yes"]',
        "value": 'cn({ on: "deep", off: { x: [y && "deeper"] } })',
        "style": '<i style={{ a: "no", b: cn("in style") }} />',
        "chain": 'const a = "one", b = a, c = b, d = c; <i className={d} />',
        "loop": "const a = cn(b, 'x'), b = cn(a, 'y'); <i className={a} />",
    }
    table = spark.createDataFrame(list(sources.items()), "file string, source string")
    rows = resolve(stored(scan_sources(table)), editing=True).select("file", "value", "raw", "start").distinct().collect()
    of = lambda file: sorted(r["value"] for r in rows if r["file"] == file)
    assert of("list") == ["no", "yes"] and of("value") == ["deep", "deeper", "off", "on", "x"] and of("style") == ["in style"]
    assert of("chain") == ["one"] and of("loop") == ["x", "y"]
    assert all(sources[r["file"]].startswith(r["raw"], r["start"]) for r in rows)
    plain = resolve(stored(scan_sources(table.filter("file <> 'loop'")))).collect()
    assert sorted((r["file"], r["value"]) for r in plain) == [("chain", "one"), ("list", "yes"), ("style", "no"), ("value", "off"), ("value", "on")]


def test_flat_rows():
    rows = [(x.kind, x.value, x.role, x.owner, x.nested, x.in_value) for x in scan('const v = "x"; <i className={v} style={{ a: 1 }} />')]
    assert rows == [("use", "v", "class", None, False, False), ("style", "1", "style", None, False, False), ("declared", "", "class", "v", False, False), ("string", "x", "class", "v", False, False)]


def test_position_of_template():
    source = "x;\n   <i className={`a\nb`} />"
    (leaf,) = scan(source)
    assert places(source, [leaf]) == [(1, 18, "<i className={`a")]


@pytest.mark.parametrize("source", ["const a = (", '"open', "<div>", "`x", "a)"])
def test_errors(source):
    with pytest.raises(ScanError):
        scan(source)


def test_extract(spark):
    rows = [("a.tsx", '<i className="p-1 p-2" style={{ paddingTop: "25px" }} />'), ("bad.tsx", "("), ("none.tsx", "let x = 1"), ("null.tsx", None)]
    sources = spark.createDataFrame(rows, "file string, source string")
    assert [(r["class"], r["line"], r["column"]) for r in extract_classes(sources).orderBy("emit_seq").collect()] == [("p-1", 0, 13), ("p-2", 0, 13), ("style:paddingtop:25", 0, 32)]
    assert [r["file"] for r in extract_errors(sources).collect()] == ["bad.tsx"]
    assert extract_classes(sources.limit(0)).count() == 0


def test_one_long_line(spark):
    """Spans of one line of a bundle do not carry the line: time and output grow with the source, in batches of bounded size."""
    took = []
    for n in (1_000, 8_000):
        source = ";".join(f'cn("c{i} d")' for i in range(n))
        began = time.time()
        table = spark.createDataFrame([("f", source)], "file string, source string")
        leaves = scan_sources(table)
        assert [f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema] == LEAVES.split(", ")
        row = leaves.agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("shown")).first()
        took.append(time.time() - began)
        assert row["n"] == n and row["shown"] == 140 * n
    assert took[1] < 8 * max(took[0], 0.5)


def walk(sources, cap=8):
    """The classes of each file in order, by following every name down (declarations: name -> list of strings and ("use", name))."""
    out = {}
    for file, (names, asked) in sources.items():
        def follow(name, seen):
            for x in names.get(name, []):
                if isinstance(x, str):
                    yield x
                elif x[1] not in seen:
                    yield from follow(x[1], seen | {x[1]})

        out[file] = []
        for root in asked:
            met = {}
            for c in follow(root, {root}):
                met[c] = met.get(c, 0) + 1
                if met[c] <= cap:
                    out[file].append(c)
    return out


def test_names(spark):
    """Aliases of aliases, shared ones, loops within and below others, against a walk down every way."""
    rng = random.Random(20)
    made, rows = {}, []
    for f in range(30):
        names = [f"n{i}" for i in range(rng.randrange(2, 7))]
        loops = f % 3 == 0
        lists = {}
        for i, n in enumerate(names):
            below = names if loops else names[i + 1 :]
            lists[n] = [("use", rng.choice(below)) if below and rng.random() < 0.6 else f"{n}-{k}" for k in range(rng.randrange(4))]
        asked = [rng.choice(names) for _ in range(2)]
        say = lambda x: x[1] if isinstance(x, tuple) else f'"{x}"'
        text = ";\n".join(f"const {n} = [{', '.join(map(say, v))}]" for n, v in lists.items())
        rows.append((f"f{f}", text + ";\n" + "".join(f"<i className={{{a}}} />;\n" for a in asked)))
        made[f"f{f}"] = (lists, asked)
    found = extract_classes(spark.createDataFrame(rows, "file string, source string")).orderBy("file", "emit_seq").collect()
    want = walk(made)
    for f, (lists, _) in made.items():
        # arrays of declarations count by themselves too: what is asked for comes behind these
        got = [r["class"] for r in found if r["file"] == f]
        assert got[len(got) - len(want[f]) :] == want[f], f


def test_doubling_names(spark):
    """Forty names, each of which stands for the next one twice: the first places of a class, in linear time."""
    source = ";\n".join(f"const v{i} = on ? v{i + 1} : v{i + 1}" for i in range(40)) + ';\nconst v40 = "end";\n<i className={v0} />'
    began = time.time()
    got = extract_classes(spark.createDataFrame([("f", source)], "file string, source string")).collect()
    assert [(r["class"], r["line"]) for r in got] == [("end", 40)] * 8
    assert time.time() - began < 30


def test_any_failure_is_of_its_source(spark):
    """What breaks the reader in any way is an error row; other files are read."""
    bad = ["(", "(" * 50_000, r'cn("\u{110000}")', "`${", "cn('", "{" * 3000]
    rows = [(f"bad{i}", s) for i, s in enumerate(bad)] + [("good", '<i className="a" style={{ zIndex: 1e400 }} />')]
    sources = spark.createDataFrame(rows, "file string, source string")
    assert {r["file"] for r in extract_errors(sources).collect()} == {f"bad{i}" for i in range(len(bad))}
    assert {r["class"] for r in extract_classes(sources).collect()} == {"a", "style:zindex:infinity"}


def test_cap(spark):
    source = ";\n".join('<i className="x" />' for _ in range(12))
    got = extract_classes(spark.createDataFrame([("a", source)], "file string, source string"))
    assert cap_locations(got).count() == 8
    assert cap_locations(got, None).agg(F.max("loc_rank")).first()[0] == 12
