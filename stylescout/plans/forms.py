"""Forms of source text and the classes that each holds, as (source, [(class, line), ...]); ``{n}`` stands for a number."""

from __future__ import annotations

FORMS: list[tuple[str, list[tuple[str, int]]]] = [
    ('<i className="a-{n} b" />', [("a-{n}", 0), ("b", 0)]),
    ('<i className={"a-{n}"} />', [("a-{n}", 0)]),
    ("<i className={`a-{n} ${on ? \"b\" : 'c'} d`} />", [("a-{n}", 0), ("d", 0), ("b", 0), ("c", 0)]),
    ('cn("a-{n}", on && "b", m ? "c" : "d", "e f")', [("a-{n}", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 0), ("f", 0)]),
    ('clsx({ "p-{n}": true, active: x, [k]: 1, "!mt-2": y })', [("p-{n}", 0), ("active", 0), ("!mt-2", 0)]),
    ('const i = ["a-{n} b", cn("c", twMerge("d"))];', [("a-{n}", 0), ("b", 0), ("c", 0), ("d", 0)]),
    ('const v = "a-{n}"; const w = v; <i className={w} />', [("a-{n}", 0)]),
    ("const a = b; const b = a; <i className={a} />", []),
    ('let x = "old"; { let x = "new-{n}"; } <i className={x} />', [("new-{n}", 0)]),
    ('let x = "old-{n}"; let x = other(); <i className={x} />', []),
    ('const k = cn("t-{n}"); <i className={k} />', [("t-{n}", 0), ("t-{n}", 0)]),
    ('<b style={{ minHeight: "{n}vh", fontSize: {n}, x: y }} />', [("style:minheight:{n}vh", 0), ("style:fontsize:{n}", 0)]),
    ('const o = { zIndex: {n}, "padding-top": "2px" };\n<b style={o} />', [("style:zindex:{n}", 0), ("style:paddingtop:2", 0)]),
    ('#!/usr/bin/env node\n<i className="p-{n}" />', [("p-{n}", 1)]),
    ('new cn("n"); cn<string>("g-{n}")', [("g-{n}", 0)]),
    ('new Box(cn("m-{n}"))', [("m-{n}", 0)]),
    ('<i className="a&amp;{n} &lt;b" />', [("a&{n}", 0), ("<b", 0)]),
    ('// cn("no")\n/* cn("no") */ cn("y-{n}")', [("y-{n}", 1)]),
    ('const r = /["(]/; cn("r-{n}")', [("r-{n}", 0)]),
    ('lib.cn("m-{n}"); lib?.cx("n")', [("m-{n}", 0), ("n", 0)]),
    ('foo("no"); cn("y-{n}" + z)', []),
    ('cn("a" as string, "b-{n}")', [("b-{n}", 0)]),
    ('<div className={on || "o-{n}"}>it is {"no"}\n<b className="in" /></div>', [("o-{n}", 0), ("in", 1)]),
    ('cn(...["s-{n}", "t"])', [("s-{n}", 0), ("t", 0)]),
    ('const l = [<b className="no" />, "yes-{n}"]', [("yes-{n}", 0)]),
    ("<i class=\"no\" className=\"q-{n}\" />", [("q-{n}", 0)]),
    ('cn(a ? b ? "x-{n}" : "y" : "z")', [("x-{n}", 0), ("y", 0), ("z", 0)]),
    ('cn(x ?? "d-{n}")', [("d-{n}", 0)]),
    ('cn({ ...rest, "k-{n}": 1 })', [("k-{n}", 0)]),
    ("<i className={`a-{n}\n  b`} />", [("a-{n}", 0), ("b", 0)]),
    ('const f = () => cn("arrow-{n}"); function g() { return cx("fn") }', [("arrow-{n}", 0), ("fn", 0)]),
    ('if (a < b) { cn("lt-{n}") } else cn("el")', [("lt-{n}", 0), ("el", 0)]),
    ('if (a < b && c > (d)) cn("gt-{n}")', [("gt-{n}", 0)]),
    ('<></>;\n<A.B x={1} {...p} className="ab-{n}" />', [("ab-{n}", 1)]),
    (r'cn("\x41-{n}")', [("A-{n}", 0)]),
    ('type T = { a: string }; const s: Record<string, "u"> = {}; cn("ty-{n}")', [("ty-{n}", 0)]),
    ('cn(fn("no"), "ok-{n}")', [("ok-{n}", 0)]),
    ('const t = cond ? ["arr-{n}"] : []', [("arr-{n}", 0)]),
    ('export default { data: ["d-{n}", { key: "no" }] }', [("d-{n}", 0), ("key", 0)]),
    ('cn(["n-{n}", ["m"]])', [("n-{n}", 0), ("m", 0)]),
    ('const c = "c-{n}"; cn(c, c)', [("c-{n}", 0), ("c-{n}", 0)]),
    ("const u = x; cn(u)", []),
    ('<p>{list.map(i => <li className={cn("li-{n}")} />)}</p>', [("li-{n}", 0)]),
    ('async function h() { await cn("aw-{n}"); }', [("aw-{n}", 0)]),
    ('cn("x-{n}"', []),
    (r'cn("\u{110000}", "x-{n}")', []),
    ('<b style={{ zIndex: 1e400, order: {n} }} />', [("style:zindex:infinity", 0), ("style:order:{n}", 0)]),
    ('if (x) /["(]/.test(y);\ncn("re-{n}")', [("re-{n}", 1)]),
    ('for (const m of l) cn("for-{n}") / 2; a.if(b) / c("/")', [("for-{n}", 0)]),
]
