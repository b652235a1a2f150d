"""Sources for the parser queries, put together from numbers of each row: how many branches, loops, cases, parameters, hooks and elements a file has varies from row to row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GO = """package sample

import "os"

type Store struct{ names map[string]int }

// Find looks a name up.
func (s *Store) Find(name string, most int) (int, error) {
	for i := 0; i < most && i < len(s.names); i++ {
		if n, ok := s.names[name]; ok || i == @N {
			switch {
			case n > @N:
				return n, nil
			default:
				break
			}
		} else if name == "func x() {" {
			return 0, os.ErrNotExist
		}
	}
	return 0, nil
}

func drop@N(a, b string, c int) {
	_ = os.Remove(a)
	_, _ = os.Open(b)
}
"""
RUST = """/// A sample.
pub struct Store<T> { items: Vec<T> }

impl<T: Clone> Store<T> {
    pub async fn find(&self, key: usize) -> Option<T> {
        if key > @N && !self.items.is_empty() {
            match self.items.get(key) {
                Some(x) if key != 7 => return Some(x.clone()),
                Some(_) => { println!("if {}", key); }
                None => {}
            }
        } else {
            for _ in 0..@N { std::hint::black_box(key); }
        }
        None
    }
}

unsafe fn raw@N(a: *const u8, b: HashMap<u8, (u8, u8)>) {}
"""
TSX = """import React, { useState, useEffect } from 'react';
import * as log from './log@N';

export default function Panel({ title, items: rows }: Props) {
  const [open, setOpen] = useState<boolean>(false);
  const [n, setN] = useState(@N);
  useEffect(() => { log.say(`${title} ${n > 1 ? 'many' : "one"}`); }, [n]);
  const handleKey = (e) => { if (e.key === 'x') setOpen(!open); };
  return (
    <Card onKeyDown={handleKey}>
      {rows.map((r) => <Row key={r.id} text="a } b" />)}
      {open ? <Row /> : <Empty>it's &lt;empty&gt;</Empty>}
    </Card>
  );
}

const Small = React.memo(({ id }) => { log.track(id); return <Row id={id} />; });
const ready = useReady(@N);
"""
#: What a row's file is made of; SQL has the same numbers.
PARTS = {"a": "doc_id % 4", "b": "doc_id div 4 % 4", "c": "doc_id div 16 % 4", "d": "n_chars % 4", "e": "n_chars div 4 % 3", "p": "n_chars div 12 % 4"}
PARTS_SQL = "pt AS (SELECT doc_id, " + ", ".join(f"CAST({v.replace('div', '//')} AS INTEGER) AS {k}" for k, v in PARTS.items()) + " FROM documents)"


def _n(text: str, column: str) -> Column:
    return F.repeat(F.lit(text), F.col(column))


def _first(texts: list[str], column: str) -> Column:
    return F.array_join(F.slice(F.array(*map(F.lit, texts)), F.lit(1), F.col(column)), "")


def _if(condition: str, *parts: Column | str) -> Column:
    return F.when(F.expr(condition), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))).otherwise("")


def _go() -> list[Column | str]:
    return [
        'package sample\n\nimport "os"\n\ntype Store struct{ names map[string]int }\n\nfunc (s *Store) Find@N(ok bool',
        _first([f", p{i} string" for i in range(4)], "p"),
        ") (int, error) {\n",
        _n("\tif ok && len(s.names) > 1 {\n\t\treturn 1, nil\n\t}\n", "a"),
        _n("\tfor ok {\n", "b"),
        _n("\t}\n", "b"),
        _if("c > 0", "\tif !ok {\n", F.repeat(F.lit("\t} else if ok {\n"), F.col("c") - 1), "\t}\n"),
        _if("d > 0", "\tswitch {\n", _n("\tcase ok:\n\t\tif ok {\n\t\t}\n", "d"), "\tdefault:\n\t}\n"),
        "\treturn 0, nil // if x {\n}\n\nfunc drop@N(a, b string) {\n",
        _n("\t_ = os.Remove(a)\n", "e"),
        _n("\t_, _ = os.Open(b)\n", "p"),
        _if("c > 1", "\tgo func() {\n\t\tif a == b {\n\t\t}\n\t}()\n"),
        "}\n",
    ]


def _rust() -> list[Column | str]:
    return [
        "/// A sample.\npub struct Store<T> { items: Vec<T> }\n\nimpl<T: Clone> Store<T> {\n    ",
        _if("d % 2 = 1", "pub "),
        _if("e > 0", "async "),
        "fn find@N(&self",
        _first([f", p{i}: u8" for i in range(4)], "p"),
        ") -> u8 {\n",
        _n("        if self.ok && x {\n            y();\n        }\n", "a"),
        _n("        while x {\n", "b"),
        "        y();\n",
        _n("        }\n", "b"),
        _if("c > 0", "        match x {\n", F.repeat(F.lit("            1 => y(),\n"), F.col("c") - 1), "            _ => {}\n        }\n"),
        _n("        loop {\n            break;\n        }\n", "d"),
        "        0 // if x {\n    }\n}\n\nunsafe fn raw@N(a: *const u8, b: HashMap<u8, (u8, u8)>) {}\n",
    ]


def _tsx() -> list[Column | str]:
    return [
        "import React from 'react';\nimport * as log from './log@N';\n\n",
        _if("d % 2 = 1", "export default "),
        _if("d = 2", "export "),
        "function Panel@N({ title",
        _first([f", p{i}" for i in range(4)], "p"),
        " }: Props) {\n",
        _n("  const [open, setOpen] = useState(0);\n", "a"),
        _n("  useEffect(() => { go('if (x) {'); }, []);\n", "b"),
        _n("  if (open) { go(); }\n", "c"),
        _n("  const x = open ? 1 : 2;\n", "d"),
        _n("  for (const y of z) { go(y); }\n", "e"),
        _if("c > 1", "  const handleIt = (ev) => { go(ev.code); };\n"),
        _if("e > 0", "  log.track(1);\n"),
        "  return (\n    <Card",
        _if("d > 1", " onKeyDown={go}"),
        ">\n",
        _n("      <Row id={1} />\n", "p"),
        "      <Empty>a } b</Empty>\n    </Card>\n  );\n}\n\nconst Small = React.memo(({ id }) => { return <Row id={id} />; });\nconst ready = useReady(@N);\n",
    ]


_ALL = {"go": (_go, "go", ".go"), "rust": (_rust, "rust", ".rs"), "tsx": (_tsx, "ts", ".tsx")}


def files(documents: DataFrame, kind: str) -> DataFrame:
    """(lang, path, content): a source for each document."""
    body, lang, ext = _ALL[kind]
    rows = documents.select("doc_id", *(F.expr(v).cast("int").alias(k) for k, v in PARTS.items()))
    made = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in body()))
    return rows.select(F.lit(lang).alias("lang"), F.concat(F.lit("src/f"), "doc_id", F.lit(ext)).alias("path"), F.replace(made, F.lit("@N"), F.col("doc_id").cast("string")).alias("content"))
