"""Filings as XML: header, singleton sections and repeated groups, whatever the namespace."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, reduce
from itertools import chain
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Filings that are written to one Arrow batch; more would only hold more of them in memory.
BLOCK = 256


@dataclass(frozen=True)
class Layout:
    """Where values are. A path is local tag names from the root with `*` for any; of several the first non-blank counts.

    `//A|B` is any descendant, in document order, of one of these names, whose case doesn't count; `//P//C` one within another.
    `@x` is the root's first attribute whose name ends in x, whatever the case.

    header: column to paths, where `required` must be present. groups: name to (path of a row, column to path within it).
    sections: likewise for what occurs once, as one struct, null where the filing hasn't that section.
    """

    header: dict[str, tuple[str, ...]]
    required: tuple[str, ...] = ()
    groups: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = field(default_factory=dict)
    sections: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = field(default_factory=dict)

    def only(self, *parts: str, header: Iterable[str] | None = None) -> Layout:
        """The header, or its required columns and these, and these sections and groups: what a query doesn't use needn't be looked for."""
        wanted = self.header if header is None else {c: paths for c, paths in self.header.items() if c in {*self.required, *header}}
        groups, sections = ({p: what[p] for p in parts if p in what} for what in (self.groups, self.sections))
        return Layout(wanted, self.required, groups, sections)

    @cached_property
    def asking(self) -> dict[str, dict[str, tuple[str, ...]]]:
        """`asking` of the header (under an empty name), each section and each group."""
        return {"": asking(self.header), **{name: asking(columns) for name, (_, columns) in (self.sections | self.groups).items()}}

    @cached_property
    def named(self) -> dict[str, Names]:
        """Likewise the names that are looked for, in the whole filing those of the header and where sections and groups begin."""
        parts = self.sections | self.groups
        begin = [path for path, _ in parts.values()]
        return {"": Names([*begin, *chain(*self.header.values())]), **{name: Names(chain(*columns.values())) for name, (_, columns) in parts.items()}}

    def __getstate__(self) -> dict[str, object]:
        """What has been worked out stays behind: workers do so themselves."""
        return {f: getattr(self, f) for f in self.__dataclass_fields__}


def asking(columns: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Columns by the lower-cased last name of their paths; under an empty name those that no element's name can rule out."""
    out: dict[str, list[str]] = {}
    for column, paths in columns.items():
        for path in paths:
            last = path.rsplit("/", 1)[-1]
            for name in [""] if last in ("", "*") or path.startswith("@") else last.lower().split("|"):
                out.setdefault(name, []).append(column)
    return {name: tuple(dict.fromkeys(some)) for name, some in out.items()}


@lru_cache(65536)
def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def nodes(root: ElementTree.Element, path: str) -> list[ElementTree.Element]:
    found, steps, deep = [root], path.split("/"), False
    for i, step in enumerate(steps):
        if not step:
            deep = 0 < i  # an empty step behind the first slash: the next name is looked for at any depth
        elif deep:
            names, deep = {n.lower() for n in step.split("|")}, False
            found = [n for top in found for n in top.iter() if n is not top and local(n.tag).lower() in names]
        else:
            found = [child for node in found for child in node if step in ("*", local(child.tag))]
    return found


#: Columns whose tags don't follow from their names, beside the one that would.
TAGS = {
    "zipcd": ("ZIPCd",), "recipient_ein": ("RecipientEIN", "EIN"), "ein": ("EIN",), "ptin": ("PTIN",), "boyamt": ("BOYAmt",), "eoyamt": ("EOYAmt",), "ubicode_vamt": ("UBICodeVAmt",),
    "attr_organization501c_type_txt": ("Organization501cTypeTxt", "AttrOrganization501cTypeTxt"), "direct_controlling_nacd": ("DirectControllingNACd",), "mission_desc_txt": ("RestrictionsOnAwardsTxt",),
    "employee_benefits_amt": ("EmployeeBenefitProgramAmt",), "expense_account_amt": ("ExpenseAccountOtherAllwncAmt",), "form1120_pol_filed_ind": ("Form1120POLFiledInd",),
    "interest_on_savings_temp_cash_investments_rev_and_expnss_amt": ("InterestOnSavingsTempCashInvstRevAndExpnssAmt",),
}
#: Amounts whose tag several groups of Schedule C share, with the group that each belongs to.
OWN, AVERAGE_LOBBYING, AVERAGE_GRASSROOTS = "FilingOrganizationsTotalAmt", "AvgLobbyingNontaxableAmountGrp", "AvgGrassrootsNontaxableGrp"
SCHEDULE_C_AMOUNTS = {
    "total_grassroots_lobbying_amt": ("TotalGrassrootsLobbyingGrp", OWN), "total_direct_lobbying_amt": ("TotalDirectLobbyingGrp", OWN), "total_lobbying_expend_grp_amt": ("TotalLobbyingExpendGrp", OWN),
    "other_exempt_purpose_expend_amt": ("OtherExemptPurposeExpendGrp", OWN), "total_exempt_purpose_expenditures_amt": ("TotalExemptPurposeExpendGrp", OWN), "lobbying_nontaxable_amt": ("LobbyingNontaxableAmountGrp", OWN),
    "grassroots_nontaxable_amt": ("GrassrootsNontaxableGrp", OWN), "lobbying_grassroots_excess_amt": ("TotLbbyngGrassrootMnsNonTxGrp", OWN), "lobbying_excess_amt": ("TotLbbyExpendMnsLbbyngNonTxGrp", OWN),
    "avg_lobbying_nontaxable_current_amt": (AVERAGE_LOBBYING, "CurrentYearAmt"), "avg_lobbying_nontaxable_total_amt": (AVERAGE_LOBBYING, "TotalAmt"),
    "avg_grassroots_nontaxable_current_amt": (AVERAGE_GRASSROOTS, "CurrentYearAmt"), "avg_grassroots_nontaxable_total_amt": (AVERAGE_GRASSROOTS, "TotalAmt"),
} | {
    f"avg_{name}_nontaxable_minus{n}_amt": (group, f"CurrentYearMinus{n}Amt") for name, group in (("lobbying", AVERAGE_LOBBYING), ("grassroots", AVERAGE_GRASSROOTS)) for n in (1, 2, 3)
}


def tags(column: str) -> tuple[str, ...]:
    """Candidate tags of a column: its name in camel case, then others it is known by."""
    return tuple(dict.fromkeys(("".join(p.capitalize() for p in column.split("_")), *TAGS.get(column, ()))))


def anywhere(*columns: str) -> dict[str, tuple[str, ...]]:
    """Columns with the path of the first descendant that has one of their tags."""
    return {c: (f"//{'|'.join(tags(c))}",) for c in columns}


def schedule_c(*columns: str) -> dict[str, tuple[str, ...]]:
    """Columns of Schedule C: amounts under their own group, anything else anywhere in the schedule."""
    scoped = {c: (f"//{group}//{tag}",) for c, (group, tag) in SCHEDULE_C_AMOUNTS.items()}
    return anywhere(*columns) | scoped


def without_placeholders(rows: DataFrame, amount: str = "cash_grant_amt", ignored: tuple[str, ...] = ("filing_id", "row_no")) -> DataFrame:
    """Recipient rows that say something: not those that are blank, or hold nothing but an amount of zero."""
    others = [c for c in rows.columns if c not in (amount, *ignored)]

    def filled(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))

    zero = F.coalesce(F.expr(f"try_cast(regexp_replace(`{amount}`, '[,$]', '') AS double)") == 0, F.lit(False))
    return rows.where(reduce(lambda a, b: a | b, map(filled, others), filled(amount) & ~zero))


@lru_cache(4096)
def descendant_names(path: str) -> tuple[str, ...]:
    """Lower-cased names of a path that is one step to any depth, else none."""
    return tuple(dict.fromkeys(path[2:].lower().split("|"))) if path.startswith("//") and "/" not in path[2:] else ()


@lru_cache(4096)
def single_name(paths: tuple[str, ...]) -> str:
    """The name that a column's one path looks for at any depth, if it is one, else an empty one."""
    names = descendant_names(paths[0]) if len(paths) == 1 else ()
    return names[0] if len(names) == 1 else ""


@lru_cache(65536)
def folded(tag: str) -> str:
    """A tag's local name in lower case; corpora have few different tags."""
    return local(tag).lower()


@lru_cache(65536)
def plain_steps(path: str) -> tuple[str, ...]:
    """Names of a path from child to child, else none."""
    steps = tuple(path.split("/"))
    return steps if all(steps) and "*" not in steps and not path.startswith("@") else ()


class Names(dict):
    """Tags to their folded names where a step of some path has that name, else to None; as many as a corpus has, up to a limit."""

    def __init__(self, paths: Iterable[str]) -> None:
        super().__init__()
        self.wanted = {name.lower() for path in paths for step in path.split("/") for name in step.split("|")}

    def __missing__(self, tag: str) -> str | None:
        if len(self) >= 65536:
            self.clear()
        name = folded(tag)
        self[tag] = found = name if name in self.wanted else None
        return found


class Below:
    """An element with those below it that have one of the names, found in one walk however many columns and groups ask.

    Only the elements of each tag are noted, in document order; texts are looked at where a column asks, since a filing has few of a layout's columns.
    """

    def __init__(self, top: ElementTree.Element, names: Names | None = None) -> None:
        self.top, self.by_tag, self.firsts, self.children = top, {}, {}, {}
        by_tag = self.by_tag
        walk = top.iter()
        next(walk)  # top itself
        for place, node in enumerate(walk):
            tag = folded(node.tag) if names is None else names[node.tag]
            if tag is None:
                continue
            if tag in by_tag:
                by_tag[tag].append((place, node))
            else:
                by_tag[tag] = [(place, node)]

    def nodes(self, path: str) -> list[ElementTree.Element]:
        if names := descendant_names(path):
            hits = [self.by_tag[n] for n in names if n in self.by_tag]
            found = hits[0] if len(hits) == 1 else sorted((p for h in hits for p in h), key=lambda p: p[0])
            return [node for _, node in found]
        return nodes(self.top, path)

    def first(self, tag: str) -> tuple[int, str] | None:
        """Place and text of the first element of a tag that has a text."""
        if tag not in self.firsts:
            self.firsts[tag] = next(((place, t) for place, node in self.by_tag[tag] if (t := (node.text or "").strip())), None)
        return self.firsts[tag]

    def reached(self, steps: tuple[str, ...]) -> list[ElementTree.Element]:
        """Elements at the end of steps from child to child; paths share their beginnings."""
        if not steps:
            return [self.top]
        if steps not in self.children:
            last = steps[-1]
            before = self.reached(steps[:-1]) if last.lower() in self.by_tag else ()
            self.children[steps] = [child for node in before for child in node if local(child.tag) == last]
        return self.children[steps]

    def at(self, path: str) -> str | None:
        if names := descendant_names(path):
            hits = [hit for n in names if n in self.by_tag and (hit := self.first(n))]
            return (hits[0] if len(hits) == 1 else min(hits))[1] if hits else None
        if path.startswith("@"):
            return next((v for k, v in self.top.attrib.items() if local(k).lower().endswith(path[1:].lower())), None)
        found = self.reached(steps) if (steps := plain_steps(path)) else nodes(self.top, path)
        return next((t for n in found if (t := (n.text or "").strip())), None)

    def values(self, columns: dict[str, tuple[str, ...]], by_name: dict[str, tuple[str, ...]] | None = None) -> dict[str, str | None]:
        """The first text of each column; only those are looked for that an element's name asks for."""
        by_name = asking(columns) if by_name is None else by_name
        out: dict[str, str | None] = dict.fromkeys(columns)
        looked, by_tag = set(), self.by_tag
        for name in by_name.keys() & by_tag.keys():
            for c in by_name[name]:
                if c not in looked:
                    looked.add(c)
                    if single_name(columns[c]) == name:
                        for _, node in by_tag[name]:
                            if (text := node.text) and (text := text.strip()):
                                out[c] = text
                                break
                    else:
                        out[c] = self.of(columns[c])
        for c in by_name.get("", ()):
            if c not in looked:
                out[c] = self.of(columns[c])
        return out

    def of(self, paths: tuple[str, ...]) -> str | None:
        return next((t for p in paths if (t := self.at(p)) is not None), None)


def parse(content: bytes, layout: Layout) -> tuple[dict[str, str | None], dict[str, object], str | None]:
    """Header; sections, and rows of each group without all-blank ones; an error where the filing is unusable."""
    try:
        root = ElementTree.fromstring(content)
    except (ElementTree.ParseError, TypeError) as e:  # also no content at all
        return {}, {}, f"not XML: {e}"
    asked, named = layout.asking, layout.named
    whole = Below(root, named[""])
    header = whole.values(layout.header, asked[""])
    if missing := [c for c in layout.required if header.get(c) is None]:
        return header, {}, f"missing {', '.join(missing)}"
    found: dict[str, object] = {}
    for name, (path, columns) in layout.sections.items():
        first = next(iter(whole.nodes(path)), None)
        found[name] = None if first is None else Below(first, named[name]).values(columns, asked[name])
    for name, (path, columns) in layout.groups.items():
        rows = [Below(n, named[name]).values(columns, asked[name]) for n in whole.nodes(path)]
        found[name] = [r for r in rows if any(r.values())]
    return header, found, None


def read_filings(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """One row per file: path, header struct, a struct for each section, an array of structs for each group, error.

    Explode a group for its child rows; cache or write this first, so that files are parsed once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path)
    return parse_filings(files.select("path", "content"), layout)


def parse_filings(files: DataFrame, layout: Layout) -> DataFrame:
    def struct(columns: object) -> tuple[str, pa.DataType]:
        return f"struct<{','.join(f'`{c}`:string' for c in columns)}>", pa.struct([(c, pa.string()) for c in columns])

    header, parts = struct(layout.header), [(s, *struct(columns)) for s, (_, columns) in layout.sections.items()]
    lists = [(g, *struct(columns)) for g, (_, columns) in layout.groups.items()]
    ddl = "".join([*(f", `{s}` {t}" for s, t, _ in parts), *(f", `{g}` array<{t}>" for g, t, _ in lists)])
    schema = pa.schema([("path", pa.string()), ("header", header[1]), *((s, t) for s, _, t in parts), *((g, pa.list_(t)) for g, _, t in lists), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                out = []
                for path, content in zip(*(batch.column(c).slice(start, BLOCK).to_pylist() for c in ("path", "content")), strict=True):
                    values, found, error = parse(content, layout)
                    present = {s: found.get(s) for s in layout.sections} | {g: found.get(g, []) for g in layout.groups}
                    out.append({"path": path, "header": {c: values.get(c) for c in layout.header}, **present, "error": error})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return files.select("path", "content").mapInArrow(run, f"path string, header {header[0]}{ddl}, error string")


def path_counts(contents: Iterable[bytes]) -> dict[tuple[str, str, bool], list[int]]:
    """(version, path, whether it is the root's) of some files' elements to the files that have it and those that have a text there."""
    counts: dict[tuple[str, str, bool], list[int]] = {}
    tree: dict[str, tuple[str, dict]] = {}  # tags to their path and the tags below: a path is put together once
    for content in contents:
        try:
            root = ElementTree.fromstring(content)
        except (ElementTree.ParseError, TypeError):
            continue
        top = tree.setdefault(root.tag, (f"/{local(root.tag)}", {}))
        seen, open_nodes = {}, [(root, top)]
        while open_nodes:
            node, (path, below) = open_nodes.pop()
            if (text := node.text) and text.strip():
                seen[path] = 1
            elif path not in seen:
                seen[path] = 0
            for child in node:
                step = below.get(child.tag)
                if step is None:
                    step = below[child.tag] = (f"{path}/{local(child.tag)}", {})
                open_nodes.append((child, step))
        version = next((v for k, v in root.attrib.items() if local(k).lower().endswith("version")), "")
        for path, filled in seen.items():
            count = counts.setdefault((version, path, path == top[0]), [0, 0])
            count[0] += 1
            count[1] += filled
    return counts


def element_paths(files: DataFrame) -> DataFrame:
    """How often each path of elements occurs in a corpus: version, path, filings, filled (filings with a text there), files.

    Files (path, content) that aren't XML count nowhere; `version` is the root's, '' without one; `files` is the
    number of that version's. Paths leave their Python task once per batch of files, and counts are combined again before the shuffle.
    """
    schema = pa.schema([("version", pa.string()), ("path", pa.string()), ("root", pa.bool_()), ("filings", pa.int64()), ("filled", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*key, *count) for key, count in path_counts(x.as_py() for x in batch.column("content")).items()]
            yield pa.RecordBatch.from_arrays([pa.array((r[i] for r in rows), f.type) for i, f in enumerate(schema)], schema=schema)

    paths = files.select("content").mapInArrow(run, "version string, path string, root boolean, filings long, filled long")
    counted = paths.groupBy("version", "path", "root").agg(F.sum("filings").alias("filings"), F.sum("filled").alias("filled"))
    whole = F.sum(F.when(F.col("root"), F.col("filings"))).over(Window.partitionBy("version"))
    return counted.select("version", "path", "filings", "filled", whole.alias("files"))


def child_rows(filings: DataFrame, group: str, key: str) -> DataFrame:
    """Rows of one group with the filing's key and their place in it."""
    good = filings.where("error is null").select(F.col(f"header.{key}").alias(key), F.posexplode(group).alias("row_no", "row"))
    return good.select(key, "row_no", "row.*")
