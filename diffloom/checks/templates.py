"""Hunks of well-known configuration, schema and route files, derived from the hunks table.

The delivered change sets touch few configuration files, so rule operators also run over
these: path and lines are picked from fixed lists by arithmetic on the hunk's keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATHS = """
jest.config.ts
jest.setup.e2e.js
playwright.config.ts
playwright.ct.config.ts
.eslintrc.json
eslint.config.mjs
biome.json
.prettierrc
stylelint.config.js
.oxlintrc.json
tailwind.config.ts
web/tailwind.config.js
postcss.config.cjs
vite.config.ts
turbo.json
pnpm-workspace.yaml
lerna.json
nx.json
.yarnrc.yml
package.json
.changeset/config.json
tsconfig.json
packages/core/tsconfig.build.json
pyproject.toml
setup.cfg
tox.ini
ruff.toml
.pre-commit-config.yaml
wrangler.toml
.github/workflows/deploy.yml
.gitlab-ci.yml
Dockerfile
docker/Dockerfile.prod
docker-compose.yml
compose.dev.yaml
.dockerignore
infra/main.tf
k8s/web.yaml
deploy/service-a.yaml
schema/api.graphql
src/schema.graphqls
prisma/schema.prisma
src/db/users.schema.ts
src/db/schema/orders.ts
drizzle/migrations/0003_add.sql
drizzle.config.ts
supabase/migrations/20240101_init.sql
supabase/seed.sql
requirements.txt
requirements-dev.txt
Pipfile
alembic/versions/ab12_add.py
shop/migrations/0002_auto.py
api/routes.py
shop/urls.py
src/views.py
src/routes/(app)/shop/[id]/+page.svelte
src/routes/api/items/+server.ts
src/routes/+layout.server.ts
app/shop/[slug]/page.tsx
src/app/(group)/api/items/route.ts
app/@modal/loading.js
next.config.mjs
middleware.ts
src/pages/blog/[...slug].astro
src/pages/api/items.ts
src/pages/index.astro
src/layouts/Base.astro
src/content/posts/one.md
pages/users/[id].vue
server/api/items.get.ts
src/server/trpc/items.ts
src/lib/Counter.svelte
src/chat/socket.ts
locales/en/common.json
src/ui/card.module.css
openapi/service.yaml
src/auth/login.ts
src/middleware/session.ts
cypress.config.ts
""".split("\n")[1:-1]

LINES = r"""
  testEnvironment: 'jsdom',
  transform: { '^.+\\.tsx?$': 'ts-jest' },
  moduleNameMapper: { '^@/(.*)$': '<rootDir>/src/$1' },
  preset: 'ts-jest',
  globals: {
  coverageThreshold: { global: { lines: 80 } },
  projects: [
  use: { baseURL: 'http://localhost:3000' },
  webServer: { command: 'npm start' },
  testDir: './e2e',
  retries: 2,
  globalSetup: './setup.ts',
  "extends": ["eslint:recommended"],
  "parser": "@typescript-eslint/parser",
  "plugins": ["import"],
  "rules": { "no-console": "warn" },
  "linter": { "enabled": true },
  "formatter": { "indentStyle": "space" },
  "singleQuote": true,
  "semi": false,
  "tabWidth": 4,
  content: ['./src/**/*.{html,js}'],
  theme: {
  colors: { brand: '#123456' },
  screens: { md: '800px' },
  prefix: 'tw-',
  darkMode: 'class',
  plugins: [require('@tailwindcss/forms')],
  base: '/app/',
  outDir: 'build',
  target: 'es2020',
  resolve: { alias: { '@': '/src' } },
  envPrefix: 'APP_',
  define: { __VERSION__: '"1"' },
  sourcemap: true,
  ssr: { noExternal: ['x'] },
  import react from '@vitejs/plugin-react'
  import { VitePWA } from 'vite-plugin-pwa'
  "pipeline": {
  "tasks": { "build": { "outputs": ["dist/**"] } },
  "globalDependencies": [".env"],
  "cache": false,
  "remoteCache": { "signature": true },
packages:
  "version": "independent",
  "npmClient": "pnpm",
  "targetDefaults": { "build": {} },
nodeLinker: node-modules
  "workspaces": ["packages/*"],
  "baseBranch": "main",
  "access": "public",
  "strict": true,
  "noImplicitAny": true,
  "module": "esnext",
  "paths": { "@/*": ["src/*"] },
  "noUnusedLocals": true,
[build-system]
[tool.poetry.dependencies]
[project]
[project.scripts]
requires-python = ">=3.11"
python = "^3.12"
[testenv]
[tool.ruff]
name = "worker"
main = "src/worker.ts"
    run: npx wrangler deploy
permissions:
  contents: write
  pull_request_target:
    run: curl https://get.example.sh | bash
FROM node:20-alpine
FROM python:3.12-slim AS base
EXPOSE 8080
ENTRYPOINT ["node", "server.js"]
CMD ["npm", "start"]
  web:
    ports:
    volumes:
    networks:
type Query {
type Product @key(fields: "id") {
enum Color {
interface Node {
input NewProduct {
model User {
model Order {
enum Role {
  email String @unique
  @@index([email])
export const users = pgTable("users", {
export const orders = pgTable('orders', {
  id: serial('id').primaryKey(),
  name: varchar('name', { length: 80 }).notNull(),
  owner: integer('owner').references(() => users.id),
  slug: text('slug').unique(),
DROP TABLE old_items;
ALTER TABLE items DROP COLUMN price;
ALTER TABLE items ALTER COLUMN price TYPE numeric;
TRUNCATE sessions;
DELETE FROM logs;
UPDATE items SET price = 0;
UPDATE items SET price = 1 WHERE id = 3;
CREATE TABLE items (id int);
django==4.2
django>=5.0
requests[security]>=2.31.0
stripe==7.1.0
numpy~=1.26
    op.drop_column('items', 'price')
    op.add_column('items', sa.Column('price', sa.Integer()))
    op.execute("DROP TABLE items")
        migrations.RemoveField(model_name='item', name='price'),
        migrations.AddField(model_name='item', name='price'),
from fastapi import APIRouter
@router.get("/items/{id}")
@router.post("/items/")
from flask import Blueprint
@bp.route("/orders", methods=["GET", "POST"])
    path('shop/<int:pk>/', views.detail),
    re_path(r'^cart/$', views.cart),
export const GET = async () => new Response('ok');
export const POST = async () => new Response('ok');
export async function GET(request) {
export async function DELETE(request) {
  experimental: { ppr: true },
  images: { domains: ['a.example'] },
  output: 'standalone',
'use client'
"use server"
import 'server-only'
  list: publicProcedure.query(() => []),
  create: protectedProcedure.input(z.string()).mutation(() => 1),
  let count = $state(0);
  const double = $derived(count * 2);
  export let name;
io.on('connection', (socket) => {
socket.on('message', (m) => socket.emit('reply', m));
socket.join('room-1');
  "title": "Shop",
  "cart.empty": "Nothing here",
.card { display: flex; position: relative; }
  --brand-color: #ff0000;
const url = process.env.API_URL;
const key = import.meta.env.VITE_API_KEY;
import { DB_URL, API_TOKEN as token } from '$env/static/private';
const title = env.PUBLIC_TITLE;
  "react": "^18.2.0",
  "react": "^19.0.0",
  "lodash": "~4.17.20",
  "lodash": "4.17.21",
  "stripe": "^14.0.0",
  "dependencies": {
  "devDependencies": {
""".split("\n")[1:-1]
STATUSES = ["modified", "added", "modified", "deleted", "renamed"]
N_ADDED, N_DELETED = 5, 3


def template_hunks(hunks: DataFrame) -> DataFrame:
    """changeset_id, path, status, hunk_ord, additions, deletions of one templated hunk per hunk_id."""
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), (at % F.lit(len(values))).cast("int"))
    id_, ord_ = F.col("hunk_id"), F.col("place")
    lines = lambda n, f: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: pick(LINES, f(i)))
    return hunks.where("hunk_id is not null and hunk_ord is not null and changeset_id is not null").select("changeset_id", "hunk_id", F.col("hunk_ord").alias("place")).distinct().select(
        "changeset_id",
        pick(PATHS, id_ * 7 + ord_).alias("path"),
        pick(STATUSES, id_).alias("status"),
        id_.alias("hunk_ord"),
        lines(N_ADDED, lambda i: id_ * 13 + i * 17 + ord_ * 5).alias("additions"),
        lines(N_DELETED, lambda i: id_ * 11 + i * 23 + 3).alias("deletions"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def template_sql() -> str:
    """The same as template_hunks, for the SQL the queries are checked against."""
    pick = lambda values, at: f"({_sql_list(values)})[(({at}) % {len(values)})::int + 1]"
    return f"""select changeset_id, {pick(PATHS, 'hunk_id * 7 + place')} as path, {pick(STATUSES, 'hunk_id')} as status, hunk_id as hunk_ord,
        list_transform(range({N_ADDED}), lambda i: {pick(LINES, 'hunk_id * 13 + i * 17 + place * 5')}) as additions,
        list_transform(range({N_DELETED}), lambda i: {pick(LINES, 'hunk_id * 11 + i * 23 + 3')}) as deletions
        from (select distinct changeset_id, hunk_id, hunk_ord as place from hunks where hunk_id is not null and hunk_ord is not null and changeset_id is not null)"""
