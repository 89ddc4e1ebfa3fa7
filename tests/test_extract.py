import pytest

from kgraph.extract import languages as lang
from kgraph.extract.tables import scan

JS = """const a = require('./lib/a');
import { b } from '../b.js';
const fs = require('fs');
class Box {
  constructor() {}
  async open(x) {
    if (x) { return '}'; }
  }
}
function outer(req, res, next) {
  const rows = db.prepare('SELECT id FROM users WHERE id = ?').all();
  app.get('/x', handler);
  app.use('/api', auth);
}
const inner = async (y) => y;
exports.named = 1;
module.exports = { outer, inner: inner };
"""
PY = """from .models import User
import os

class A(Base):
    x = 1

    @property
    def name(self):
        return 1

@app.route('/')
def view(request):
    return session.query(User)

def tail():
    pass  # end
    # comment

"""
MD = """---
name: my-skill
---
# Title of lib/x.js
See `lib/a.js` and `/go`, data in state.db
```sh
node scripts/run.js docs/b.md
```
## Second
`lib/a.js`
"""
SVELTE = """<p/>
<script lang="ts">
import type { T } from './t';
import X from './X.svelte';
export let title;
let { one, two = 2, ...rest } = $props();
dispatch('saved', 1);
</script>
<slot name="head" /><slot></slot><slot />
"""


def test_javascript():
    f = lang.script(JS, "src/app.js", "js")
    assert f.nodes == [("app.js", "module", 1), ("Box", "class", 4), ("open", "method", 6), ("outer", "function", 10), ("GET /x", "route", 12), ("inner", "function", 15)]
    assert ("imports", "structural", "app.js", "./lib/a") in f.edges and ("imports", "structural", "app.js", "../b.js") in f.edges
    assert not any(e[3] == "fs" for e in f.edges)
    assert ("queries_table", "data_flow", "outer", "users") in f.edges and ("attaches", "structural", "outer", "auth") in f.edges
    assert [e[3] for e in f.edges if e[0] == "exports"] == ["named", "outer", "inner"]
    found = lang.detect("src/app.js", JS, "outer", lang.body_by_braces(JS, 10))
    assert {d[0]: d[3] for d in found} == {"parameterized-sql": 0.9, "express-middleware": 0.95}


def test_typescript():
    f = lang.script("import type { Q } from './q';\nexport interface I { a: 1 }\ntype T<X> = X;\nexport abstract class C {\n  private async run(a: number): void {\n  }\n}\nexport enum E {}\n", "a.ts", "ts")
    assert [n[:2] for n in f.nodes] == [("a.ts", "module"), ("I", "interface"), ("T", "type_alias"), ("C", "class"), ("run", "method"), ("E", "enum")]
    assert not any(e[0] == "imports" for e in f.edges)


def test_python():
    f = lang.python(PY, "pkg/m.py")
    assert f.nodes == [("m.py", "module", 1), ("A", "class", 4), ("name", "method", 8), ("view", "function", 12), ("tail", "function", 15)]
    assert ("decorates", "structural", "view", "app.route") in f.edges and ("imports", "structural", "m.py", ".models") in f.edges
    assert lang.body_by_indent(PY, 15) == "def tail():\n    pass  # end"
    assert {d[0] for d in lang.detect("m.py", PY, "view", lang.body_by_indent(PY, 12), ["app.route"])} == {"django-view", "sqlalchemy-query", "flask-route"}


def test_markdown():
    f = lang.markdown(MD, "docs/a.md")
    assert {n[:2] for n in f.nodes} == {("my-skill", "skill"), ("Title of lib/x.js", "doc_section"), ("Second", "doc_section"), ("/go", "command")}
    title = "Title of lib/x.js"
    want = {("describes", title, "lib/x.js"), ("references", title, "lib/a.js"), ("triggers", title, "/go"), ("references", title, "state.db")}
    want |= {("triggers", title, "scripts/run.js"), ("references", title, "docs/b.md"), ("references", "Second", "lib/a.js")}
    assert {(e[0], e[2], e[3]) for e in f.edges} == want


def test_svelte():
    f = lang.svelte(SVELTE, "ui/Page.svelte")
    assert f.nodes == [("Page", "component", 1), ("title", "prop", 5), ("one", "prop", 6), ("two", "prop", 6), ("head", "slot", 9), ("default", "slot", 9)]
    assert ("dispatches", "data_flow", "Page", "saved") in f.edges and ("imports", "structural", "Page", "./X.svelte") in f.edges


def test_bodies_sections_and_pairs():
    assert lang.body_of(JS, "open").startswith("  async open") and lang.body_of(JS, "inner").startswith("const inner = async (y) => y;") and lang.body_of(JS, "none") is None
    assert lang.section_of(SVELTE, "template").startswith("<p/>") and "title" in lang.section_of(SVELTE, "script") and lang.section_of(SVELTE, "style") is None
    assert lang.is_test("a/b.test.js") and lang.is_test("tests/x.py") and not lang.is_test("lib/a.js")
    assert lang.test_candidates("lib/foo/bar.js")[0] == "lib/foo/bar.test.js" and "test/foo-bar.test.js" in lang.test_candidates("lib/foo/bar.js")
    assert lang.annotations("// @tests src/a.js\n# @tests b.py\n") == ["src/a.js", "b.py"]


def test_registry_checks_plugins():
    r = lang.default_registry()
    assert r.extract("x", "a.unknown").nodes == []
    for bad in ({"id": ""}, {"category": "nope"}, {"default_term": ""}, {"function": 3}):
        with pytest.raises(ValueError):
            r.register_detector(**({"id": "d", "category": "middleware", "default_term": "t", "function": len} | bad))
    r.register_detector("d", "middleware", "term", lambda n: {"confidence": 7})
    with pytest.raises(ValueError):
        r.register_detector("d", "middleware", "term", len)
    r.register_detector("throws", "middleware", "term", lambda n: 1 / 0)
    assert r.labels({}) == [("d", "middleware", "term", 1.0, ())]


def test_scan_resolves_imports_and_makes_stubs(spark):
    files = [("p", "index.js", "const u = require('./lib/utils');\nfunction main() {\n}\nmodule.exports = { main };"), ("p", "lib/utils.js", "function helper() {\n  x.prepare('DELETE FROM t');\n}\n"), ("p", "node_modules/q/index.js", "function no() {\n}")]
    nodes, edges, labels = scan(spark.createDataFrame(files, "project string, file string, content string"))
    n = {(r.file, r.name): r for r in nodes.collect()}
    assert ("lib/utils.js", "helper") in n and ("t", "t") in n and not any(f.startswith("node_modules") for f, _ in n)
    e = {(r.type, r.target): r for r in edges.collect()}
    assert e["imports", "./lib/utils"].target_id == n["lib/utils.js", "utils.js"].id and e["exports", "main"].target_id == n["index.js", "main"].id
    assert not e["queries_table", "t"].resolved and n["t", "t"].type == "table"


def test_three_arguments_need_a_word_before_them():
    found = lambda body: [d[0] for d in lang.detect("a.js", body, "f", body)]
    assert "express-middleware" in found("function f(req, res, next) {}") and "express-middleware" in found("call(a, b, c)")
    assert found("; (a, b, c)") == [] and found("[(req, res, next)]") == []


def test_route_files_of_a_framework():
    assert [d[:4] for d in lang.detect("src/+page.server.ts", "", "load", None)] == [("svelte-load", "data-access", "load function", 0.95)]
    assert [d[4] for d in lang.detect("src/+server.js", "", "POST", "x")] == [("sveltekit", "post")]
    assert lang.detect("src/page.js", "", "load", None) == [] and lang.detect("src/+server.py", "", "GET", None) == []
