"""Raw comma-separated records: sound ones typed, the others with the reason why not.

DuckDB's CSV reader with reject tables runs on the workers, over one batch of lines at a time; its line-level errors are
joined to the raw records there, and an exact check of the raw record names the first reason that applies.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

INTEGER, NUMBER, TEXT = "integer", "number", "text"


@dataclass(frozen=True)
class CsvColumn:
    """One expected column. kind: integer (digits with an optional `.0`), number (digits with optional decimals) or text."""

    name: str
    kind: str = TEXT
    required: bool = False
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None
    arrow: str = field(default="string")

    def sql_type(self) -> str:
        return {"int64": "BIGINT", "int32": "INTEGER", "double": "DOUBLE"}.get(self.arrow, "VARCHAR")

    def sql_value(self) -> str:
        v = f"trim(\"{self.name}\", ' ')"
        return f"CASE WHEN {v} IN ('', 'NaN') THEN NULL ELSE {v} END"

    def sql_bad(self) -> str:
        """True where a value breaks this column's rule; `v` is the value without spaces around it."""
        v, tests = f'v."{self.name}"', []
        if self.required:
            tests.append(f"{v} IS NULL")
        if self.kind != TEXT:
            shape = r"[0-9]+(\.0)?" if self.kind == INTEGER else r"[0-9]+(\.[0-9]+)?"
            tests.append(f"({v} IS NOT NULL AND NOT regexp_full_match({v}, '{shape}'))")
        if self.allowed:
            one = f"TRY_CAST({v} AS DOUBLE)" if self.kind != TEXT else v
            options = ", ".join(str(x) if self.kind != TEXT else "'" + x.replace("'", "''") + "'" for x in self.allowed)
            tests.append(f"({v} IS NOT NULL AND coalesce({one} NOT IN ({options}), true))")
        if self.low is not None:
            tests.append(f"({v} IS NOT NULL AND coalesce(TRY_CAST({v} AS DOUBLE) NOT BETWEEN {self.low} AND {self.high}, true))")
        return " OR ".join(tests) or "false"


_PLAIN, _QUOTED = r'[^",]*', r'"(?:[^"]|"")*"'
_SOUND = re.compile(rf"(?:{_QUOTED}|{_PLAIN})(?:,(?:{_QUOTED}|{_PLAIN}))*+", re.S)


def shape_of(line: str, n: int) -> str | None:
    """The first of bad_quoting, too_few_columns and too_many_columns that applies to a raw line, by its characters."""
    if '"' not in line:
        count = line.count(",") + 1
    elif not _SOUND.fullmatch(line):
        return "bad_quoting"
    else:
        count = _count_fields(line)
    return "too_few_columns" if count < n else "too_many_columns" if count > n else None


def _count_fields(line: str) -> int:
    """Fields of a line whose quoting is sound: commas at an even number of quotes, and one."""
    return sum(part.count(",") for part in line.split('"')[::2]) + 1


def _spare(text: str, n: int) -> list[str]:
    """n private-use characters that the text doesn't hold."""
    out, code = [], 0xE000
    while len(out) < n:
        if chr(code) not in text:
            out.append(chr(code))
        code += 1
    return out


class _Reader:
    """DuckDB connection of one task and its file, removed with the task."""

    def __init__(self, columns: list[CsvColumn], folder: str):
        import duckdb

        self.columns, self.path = columns, Path(folder) / "batch.csv"
        self.con = duckdb.connect(config={"threads": 1})
        self.con.execute("SET memory_limit='500MB'")

    def _pass(self, lines: dict[int, str]) -> tuple[dict[int, str], list[int]]:
        """One reading: errors by line, and the lines read whole, whose values are put into the table good."""
        con = self.con
        with self.path.open("w", encoding="utf-8", newline="") as f:
            f.writelines(f"{i},{x}\n" for i, x in lines.items())
        for t in ("reject_errors", "reject_scans", "read"):
            con.execute(f"DROP TABLE IF EXISTS {t}")
        kinds = ", ".join(["'_i': 'VARCHAR'", *(f"'{c.name}': 'VARCHAR'" for c in self.columns)])
        longest = max(2_000_000, 8 * max(map(len, lines.values())))
        con.execute(
            f"CREATE TEMP TABLE read AS SELECT * FROM read_csv('{self.path}', auto_detect=false, header=false, delim=',', quote='\"', escape='\"', "
            f"new_line='\\n', columns={{{kinds}}}, strict_mode=true, null_padding=false, parallel=false, store_rejects=true, rejects_limit=0, max_line_size={longest})"
        )
        errors: dict[int, str] = {}
        for line, kind in con.execute("SELECT csv_line, error_type FROM reject_errors").fetchall():
            head = (line or "").split(",", 1)[0]
            if head.isdigit() and int(head) in lines:
                errors.setdefault(int(head), str(kind))
        spilled = " OR ".join(f"contains(coalesce(\"{c.name}\", ''), chr(10))" for c in self.columns)
        for (i,) in con.execute(f"SELECT _i FROM read WHERE {spilled}").fetchall():
            errors[int(i)] = "UNQUOTED VALUE"
        con.execute(f"INSERT INTO good SELECT * FROM read WHERE NOT ({spilled})")
        whole = [int(i) for (i,) in con.execute(f"SELECT _i FROM read WHERE NOT ({spilled})").fetchall()]
        return errors, whole

    def read(self, texts: list[str]) -> pa.Table:
        """Columns i, the typed columns, reason and csv_error for each text."""
        con, cols = self.con, self.columns
        lf, cr = _spare("".join(texts), 2)
        lines = {i: x.replace("\n", lf).replace("\r", cr) for i, x in enumerate(texts)}
        con.execute("CREATE OR REPLACE TEMP TABLE good (_i VARCHAR, " + ", ".join(f'"{c.name}" VARCHAR' for c in cols) + ")")
        left, errors = lines, {}
        while left:
            found, whole = self._pass(left)
            done = found.keys() | set(whole)
            if not done:
                found = dict.fromkeys(left, "UNREAD")
                done = found.keys()
            errors |= found
            left = {i: x for i, x in left.items() if i not in done}
        # The exact check; the reader lets pass quotes inside plain fields and a last comma too many.
        shapes = {i: shape_of(x, len(cols)) for i, x in enumerate(texts)}
        again = [i for i, s in shapes.items() if s is None and i in errors]
        for i in again:
            con.execute(f"DELETE FROM good WHERE _i = '{i}'")
            con.execute(f"INSERT INTO good VALUES ({', '.join('?' * (len(cols) + 1))})", [str(i), *_fields(lines[i])])
        told = [(i, s, errors.get(i)) for i, s in shapes.items() if s or i in errors]
        con.register("told", pa.table({"i": pa.array([x[0] for x in told], pa.int64()), "shape": pa.array([x[1] for x in told], pa.string()), "error": pa.array([x[2] for x in told], pa.string())}))
        con.register("every", pa.table({"i": pa.array(range(len(texts)), pa.int64())}))
        typed = []
        for c in cols:
            v = f'v."{c.name}"'
            if c.arrow == "string":
                typed.append(f"replace(replace({v}, '{lf}', chr(10)), '{cr}', chr(13)) AS \"{c.name}\"")
            elif c.arrow == "double":
                typed.append(f'TRY_CAST({v} AS DOUBLE) AS "{c.name}"')
            else:
                typed.append(f'TRY_CAST(regexp_replace({v}, \'\\.0$\', \'\') AS {c.sql_type()}) AS "{c.name}"')
        bad = " OR ".join(f"({c.sql_bad()})" for c in cols)
        values = ", ".join(f'{c.sql_value()} AS "{c.name}"' for c in cols)
        out = con.execute(
            f"WITH v AS (SELECT CAST(_i AS BIGINT) AS i, {values} FROM good), "
            f"t AS (SELECT v.i, CASE WHEN {bad} THEN 'bad_value' END AS worth, {', '.join(typed)} FROM v) "
            f"SELECT e.i, {', '.join(f't."{c.name}"' for c in cols)}, coalesce(told.shape, t.worth) AS reason, told.error AS csv_error "
            "FROM every e LEFT JOIN told ON told.i = e.i LEFT JOIN t ON t.i = e.i ORDER BY e.i"
        )
        table = next(getattr(out, f) for f in ("to_arrow_table", "fetch_arrow_table") if hasattr(out, f))()
        con.unregister("told")
        con.unregister("every")
        return table


def _fields(line: str) -> list[str]:
    """Values of a line whose quoting is sound."""
    out = []
    for m in re.finditer(rf"({_QUOTED}|{_PLAIN})(,|$)", line, re.S):
        v = m.group(1)
        out.append(v[1:-1].replace('""', '"') if v.startswith('"') else v)
        if not m.group(2):
            break
    return out


def read_with_rejects(lines: DataFrame, columns: list[CsvColumn], number: str = "line_no", text: str = "c0") -> DataFrame:
    """(line_no, the typed columns, reason, csv_error): one row per input row.

    reason is NULL for a sound record, else bad_quoting, too_few_columns, too_many_columns or bad_value, the first that
    applies; the typed columns of a record that isn't sound are NULL. csv_error is what the CSV reader itself reported.
    A record may hold line breaks inside quoted fields; one carriage return at its end is dropped; NULL counts as an empty
    line. A lone broken quote never takes other records with it: lines that vanish into one are read again without it.
    Repeated lines each count; a whole number beyond 64 bits becomes NULL in the typed row. Other columns are ignored.
    No shuffle: every partition is read where it lies, batch by batch; the batch file lives and ends with its task.
    """
    types = {"int64": "bigint", "int32": "int", "double": "double", "string": "string"}
    schema = f"{number} bigint, " + ", ".join(f"`{c.name}` {types[c.arrow]}" for c in columns) + ", reason string, csv_error string"
    arrow = pa.schema([pa.field(number, pa.int64()), *(pa.field(c.name, getattr(pa, {"double": "float64"}.get(c.arrow, c.arrow))()) for c in columns), pa.field("reason", pa.string()), pa.field("csv_error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            reader = _Reader(columns, folder)
            for b in batches:
                if not b.num_rows:
                    continue
                texts = [(x or "") for x in b.column(1).to_pylist()]
                texts = [x[:-1] if x.endswith("\r") else x for x in texts]
                t = reader.read(texts)
                whole = t.column("reason").is_null()
                data = [b.column(0).cast(pa.int64())]
                for c in columns:
                    v = t.column(c.name).combine_chunks().cast(arrow.field(c.name).type)
                    data.append(pa.compute.if_else(whole.combine_chunks(), v, pa.nulls(len(v), v.type)))
                data += [t.column(k).combine_chunks().cast(pa.string()) for k in ("reason", "csv_error")]
                for i, x in enumerate(data):
                    data[i] = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
                yield pa.RecordBatch.from_arrays(data, schema=arrow)

    import pyarrow.compute  # noqa: F401

    return lines.select(number, text).mapInArrow(run, schema)


CENSUS_YEARS = (1835, 1840, 1845, 1850, 1855, 1860, 1870, 1880, 1890, 1901, 1910)
_ID = {"kind": INTEGER, "arrow": "int64"}
PERSON_COLUMNS = [
    CsvColumn("id", required=True, **_ID), CsvColumn("manntal", kind=INTEGER, required=True, allowed=CENSUS_YEARS, arrow="int32"),
    *(CsvColumn(n) for n in ("nafn", "fornafn", "millinafn", "eftirnafn", "aettarnafn")),
    CsvColumn("faedingarar", kind=NUMBER, low=1600, high=1920, arrow="double"), CsvColumn("kyn", allowed=("Karl", "Kona")), CsvColumn("stada"),
    CsvColumn("hjuskapur", allowed=("Ó", "G", "E", "S", "L")), *(CsvColumn(n, **_ID) for n in ("bi_einstaklingur", "baerid", "bi_baer", "thsk_maki", "maki")),
    CsvColumn("cleaned_status"), CsvColumn("stada_group"),
]


def person_records(lines: DataFrame) -> DataFrame:
    """read_with_rejects for the 18 columns of a person's record."""
    return read_with_rejects(lines, PERSON_COLUMNS)
