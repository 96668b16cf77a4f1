"""File contents at the two sides of a change set, picked from fixed texts by the change set's hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = {
    "src/router.tsx": [
        'const r = <Routes><Route path="/" element={<Home/>}><Route index /><Route path="shop" element={<Shop/>}><Route path=":id" loader={load} /></Route></Route></Routes>;',
        'const r = <Routes><Route path="/" element={<Home/>}><Route index /><Route path="shop" element={<Shop/>} errorElement={<Oops/>} /><Route path="*" /></Route></Routes>;',
        'export const router = createBrowserRouter([{ path: "/", children: [{ index: true }, { path: "cart", loader: load }] }, { path: "*", element: <None/> }]);',
    ],
    "src/app/app.routes.ts": [
        "export const routes: Routes = [{ path: '', component: Home }, { path: 'admin', canActivate: [guard], children: [{ path: 'users', component: Users }] }];",
        "export const routes: Routes = [{ path: '', redirectTo: 'home' }, { path: 'admin', loadComponent: () => import('./a'), children: [] }];",
    ],
    "src/components/my-card.tsx": [
        "@Component({ tag: 'my-card', shadow: true })\nexport class MyCard { @Prop() title: string; @Prop() size: number; @Event() opened: EventEmitter<void>; @Method() async close() {} render() { return <slot name='footer' />; } }",
        "@Component({ tag: 'my-card', shadow: false })\nexport class MyCard { @Prop() title!: string; @Event() shut: EventEmitter<void>; render() { return <slot />; } }",
    ],
    "src/app/item.component.ts": [
        "@Component({ selector: 'app-item', standalone: true })\nexport class ItemComponent { @Input() id: string; @Output() done = new EventEmitter(); }",
        "@Component({ selector: 'app-item', changeDetection: ChangeDetectionStrategy.OnPush })\nexport class ItemComponent { @Input() id: number; }",
    ],
    "packages/ui/package.json": ['{"exports": {".": {"import": "./a.js", "require": "./a.cjs"}, "./button": "./b.js"}}', '{"exports": {".": "./a.js", "./card": {"types": "./c.d.ts", "default": "./c.js"}}}'],
    "locales/de/shop.json": ['{"title": "Laden", "cart": {"empty": "leer", "full": "voll"}}', '{"title": "Laden", "cart": {"empty": "nichts"}, "pay": {"now": "jetzt"}}'],
}


def template_blobs(files: DataFrame) -> DataFrame:
    """changeset_id, path, side, content for every change set of the file list."""
    sets = files.where("changeset_id is not null").select("changeset_id").distinct()
    rows = []
    for i, (path, texts) in enumerate(SOURCES.items()):
        choice = F.array(*[F.lit(t) for t in texts])
        at = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "changeset_id"), F.lit(len(texts))).cast("int")  # noqa: E731, B023
        rows += [F.struct(F.lit(path).alias("path"), F.lit(side).alias("side"), F.get(choice, at(10 * i + k)).alias("content")) for k, side in enumerate(("base", "head"))]
    return sets.select("changeset_id", F.explode(F.array(*rows)).alias("b")).select("changeset_id", "b.*")
