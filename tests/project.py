"""A small source tree of our own, with one of everything that extraction knows."""

from __future__ import annotations

from pathlib import Path

FILES = {
    "package.json": '{"name": "shop", "workspaces": ["packages/*"]}',
    "tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"~/*": ["src/*"]},},\n}',
    "CODEOWNERS": "*.md @docs\n/src/ @core @second\n/src/ui/ @design # looks\n",
    "src/chain.ts": """import { stepB } from "./steps";
/** Starts it all. */
export function stepA(n: number): number {
  return stepB(n) + 1;
}
""",
    "src/steps.ts": """import type { Options } from "~/types";
import * as far from "./far";
export const stepB = (n: number): number => stepC(n);
function stepC(n: number) {
  // TODO: look again
  return far.stepD(n);
}
export const LIMIT = -3;
export { stepC as renamed };
""",
    "src/far.ts": """import { pong } from "./ring";
/**
 * Old way.
 * @deprecated use stepE
 * @internal
 */
export function stepD(n: number, { deep = 1 } = {}, ...rest: string[]): Promise<Map<string, number>> {
  if (n > 1 && n < 9 || deep) {
    for (const x of rest) { switch (x) { case "a": case "b": break; default: } }
  }
  const value = n ? (n ?? 2) : 3;
  while (n--) { try { pong(value); } catch { n = 0; } }
  do { n++; } while (n < 2);
  return n as never;
}
""",
    "src/ring.ts": """import { ping } from "./ring2";
// loomgraph-disable-file unimported-exports
export function pong(n: number) { return ping(n); }
""",
    "src/ring2.ts": """import { pong } from "./ring";
import "./side";
export function ping(n: number) { return pong(n); }
export default ping;
""",
    "src/side.ts": "export {};\n// loomgraph-disable-next-line untested-and-dead\nexport function lonely() { return 1; }\n",
    "src/types.ts": """export interface Options<T = string> extends Base {
  readonly id: string;
  name?: string | null;
  run(a: number, b: string): Promise<void>;
  tags: Array<string>;
}
interface Base { kind: "x" }
export type Shape = { area: number; };
export type Pair<A extends string, B> = [A, B] | null;
export enum Colour { Red, Green = 2, Blue = "b" }
""",
    "src/ui/Button.tsx": """import { useState } from "react";
import { Frame as Box } from "./Frame";
/** @beta */
export const Button = ({ label }: ButtonProps) => {
  const [n, setN] = useState(0);
  return <Box title="it's" onClick={() => setN(n + 1)}>Don't {label ? <b>{label}</b> : null}</Box>;
};
type ButtonProps = { label: string };
export const NotOne = () => 3;
""",
    "src/ui/Frame.tsx": "export default function Frame(props: FrameProps) { useTrack(props); return null; }\nexport { Frame };\n",
    "src/ui/index.ts": 'export { Button } from "./Button";\nexport { default as Frame } from "./Frame";\nexport * from "./more";\n',
    "src/model.ts": """export class Store<T> extends Map<string, T> implements Disposable {
  private static count = 0;
  readonly size2: number = 1;
  constructor(private path: string) { super(); this.load(); }
  /** Loads. */
  async load(): Promise<void> { await fetchAll(this.path); }
  get total() { return Store.count; }
  set total(v: number) { Store.count = v; }
}
""",
    "src/style.module.css": "@import \"./base.css\";\n:root {\n  --main: #3366cc;\n  --gap: 1rem;\n}\n.card:hover, .wide { color: red }\n@keyframes fade { from { opacity: .5 } }\n",
    "src/base.css": "/* .ghost {} */ .base { margin: 0 }\n",
    "src/broken.ts": "export const a = (;\n",
    "docs/notes.md": "# Notes\r\nFIXME later\r\n\r\nHACK: now\nTODO\nnext line\nNOTE this\n",
    "packages/one/index.ts": "export const one = 1;\n",
    "node_modules/x/index.ts": "export const hidden = 1;\n",
    ".loomgraph/recipes/long-files.sql": "SELECT path, line_count FROM files WHERE line_count >= :least ORDER BY path",
    ".loomgraph/recipes/by-language.sql": "SELECT language, count(*) AS n FROM files WHERE language <> ? GROUP BY language ORDER BY language",
    ".loomgraph/recipes/by-language.md": "---\ndescription: Files by language\nparams:\n  - name: but\n    type: string\nactions:\n  - type: look\n    description: Look at it\n---\n# By language\n",
}


def make(root: Path) -> str:
    for path, text in FILES.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text.encode())
    (root / "docs/latin.txt.md").write_bytes(b"caf\xe9\n")
    return str(root)
