import time

from diffloom.functions.code_reader import export_paths, flatten_keys, join_paths, members, routes, source_changes

BLOBS = "changeset_id string, path string, side string, content string, name string"


def test_nested_route_elements():
    text = """// <Route path="no" />
    <Route path="/" element={<Home a={1} />}><Route index /><Route path="shop"><Route path=":id" loader={load} /></Route><Route path="*" /></Route>"""
    assert routes(text) == [("/", "layout", ()), ("/", "page", ()), ("/shop", "layout", ()), ("/shop/:id", "page", ("loader",)), ("/*", "catch-all", ())]


def test_route_tables():
    text = "const routes: Routes = [{ path: '', redirectTo: 'home' }, /* { path: 'x' } */ { path: 'a', children: [{ path: 'b, c', canActivate: [g] }] }, ...more, { path: computed }];"
    assert routes(text) == [("/", "redirect", ("redirectTo",)), ("/a", "layout", ()), ("/a/b, c", "page", ("canActivate",))]
    assert routes("createBrowserRouter([{ path: '/' , index: true") == [("/", "page", ())]
    assert routes("createRouter({ history: h(), routes: [{ path: '/v', children: [{ path: ':id' }] }] })") == [("/v", "layout", ()), ("/v/:id", "page", ())]
    assert routes(None) == [] and routes("") == [] and routes("x" * 100_000) == []


def test_members():
    text = "@Component({ tag: 'my-x', shadow: true }) export class X { @Prop() a: string; @Event({ eventName: 'gone' }) g: E<void>; @Method() async go() {} render() { return <slot name='s'/>; } }"
    assert members(text) == [("my-x", "component", "X", "shadow=true"), ("my-x", "slot", "s", ""), ("my-x", "prop", "a", "string"), ("my-x", "event", "gone", "E<void>"), ("my-x", "method", "go", "")]
    assert members(None) == [] and members("@Prop() lonely: string") == []


def test_json_shapes():
    assert export_paths({".": {"import": "a", "require": {"x": "b"}}, "./c": "d", "./n": None}) == [".", "./c"]
    assert export_paths("x") == ["."] and export_paths(None) == []
    assert flatten_keys({"a": {"b": 1, "c": {}}, "d": [1]}) == ["a.b", "d"]
    assert join_paths("/", "") == "/" and join_paths("/a/", "b/") == "/a/b" and join_paths("/a", "/b") == "/b"


def test_changes(spark):
    rows = [("c", "l/a.json", "base", '{"x": "1", "y": "2"}', "clash"), ("c", "l/a.json", "head", '{"x": "1", "z": "2"}', ""), ("c", "b.json", "head", "{broken", ""), ("c", "n.ts", "head", None, ""), (None, "p.ts", "head", "x", "")]
    got = sorted((r.path, r.relation, r.name, r.change) for r in source_changes(spark.createDataFrame(rows * 2, BLOBS)).collect())
    assert got == [("l/a.json", "key", "y", "removed"), ("l/a.json", "key", "z", "added")]
    assert source_changes(spark.createDataFrame([], BLOBS)).count() == 0


def test_long_texts_take_linear_time():
    for part in ("<Route path=", "@Prop(", "[(", "createBrowserRouter([", "@Prop() a; ", "<slot "):
        began = time.time()
        routes("Route " + part * 20_000)
        members("@Component({tag: 'a'}) class X { } " + part * 20_000)
        assert time.time() - began < 10, part
