"""Markup: a lexer of tags and attributes, and checks of what stands in them.

What a tag's attributes are depends on quotes, braces and the expressions nested in them, so an automaton
reads each tag, in one pass over a file's text; the checks are columns over the tags of a row. No file
is dealt out. An element whose attributes are partly unknown (spread, bound or made by a server's
template) is unknown where one is missing, never a hit.
"""

from __future__ import annotations

import functools
import re
import tomllib
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.functions.ship import map_batches

#: Characters after a tag's name in which it has to shut.
LONGEST = 4000
#: Bytes of texts whose tags are held at a time.
PIECE_BYTES = 256 << 10
#: Lexemes within a tag. A quote that does not shut is none of them.
LEXEMES = re.compile(r"""(?P<text>"[^"]*"|'[^']*'|`[^`]*`)|(?P<open>\{)|(?P<shut>\})|(?P<server><%.*?%>)|(?P<end>/?>)|(?P<is>=)|(?P<space>\s+)|(?P<name>[^\s"'`{}<>=/]+)|(?P<other>.)""", re.S)
START = re.compile(r"<(/?)([A-Za-z][\w.:-]*)(?=[\s/>]|\Z)")
#: An opening tag after one of these is a comparison.
OPERAND = re.compile(r"[\w$)\]]")
SHORTHAND = re.compile(r"\{\s*([A-Za-z_][\w-]*)\s*\}")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
TAGS = "array<struct<line:int,name:string,closing:boolean,in_label:boolean,dynamic:boolean,attributes:map<string,struct<kind:string,value:string>>>>"


@functools.cache
def values(pack: str = "frontend-a11y") -> dict[str, tuple[str, ...]]:
    """The fields of a pack of rules."""
    found = resources.files("assaykit.sources").joinpath("packs", f"{pack}.toml").read_text(encoding="utf-8")
    return {k: tuple(v) for k, v in tomllib.loads(found).items()}


class Lexer:
    def __init__(self, fields: dict[str, tuple[str, ...]]):
        self.comments, self.bindings = (tuple(map(re.compile, fields[k])) for k in ("comments", "attribute_bindings"))
        self.dynamic = re.compile("|".join(f"(?:{d})" for d in fields["dynamic_attributes"]))
        self.plain = functools.lru_cache(4096)(self.plain)  # a file's attributes are few
        self.labels = frozenset(fields["label_tags"])

    def blanked(self, text: str) -> str:
        """Comments as blanks; line ends stay."""
        for c in self.comments:
            text = c.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        return text

    def plain(self, name: str) -> str:
        """An attribute's own name, in small letters, without what binds it."""
        low = name.lower()
        return next((m["name"] for b in self.bindings if (m := b.fullmatch(low))), low)

    @staticmethod
    def attributes(text: str, at: int):
        """(end, [(name, kind, value)], whether it shuts itself) of the tag whose name ends at ``at``, None if
        it does not shut. kind is literal, expr or bare. States: waiting for a name, having one, having its
        equals sign; and the depth of open braces, in which only braces count."""
        found: list[tuple[str, str, str]] = []
        limit = min(len(text), at + LONGEST)
        name, valued, depth, opened = None, False, 0, 0

        def put(kind: str, value: str) -> None:
            nonlocal name, valued
            if name is not None:
                found.append((name, kind, value))
            name, valued = None, False

        while at < limit:
            m = LEXEMES.match(text, at, limit)
            what, at = m.lastgroup, m.end()
            if what == "other" and m[0] in "\"'`":
                return None  # a quote that does not shut
            if depth or what == "open":
                if what == "open":
                    if not depth:
                        opened = m.start()
                        if name is not None and not valued:
                            put("bare", "")
                    depth += 1
                elif what == "shut":
                    depth -= 1
                    if not depth and valued:
                        put("expr", text[opened:at])
                    elif not depth and (short := SHORTHAND.fullmatch(text, opened, at)):
                        found.append((short[1], "expr", short[0]))
            elif valued and what not in ("space", "text", "end"):
                # an unquoted value goes on to a blank or the tag's end
                stop = re.compile(r"[\s>]").search(text, m.start(), limit)
                at = stop.start() if stop else limit
                put("literal", text[m.start() : at])
            elif valued and what == "text":
                put("literal", m[0][1:-1])
            elif valued and what == "end" and m[0] == "/>":
                at = m.start() + 1
                put("literal", "/")
            elif what == "is" and name is not None:
                valued = True
            elif what == "end":
                put("literal" if valued else "bare", "")
                return at, found, m[0] == "/>"
            elif what == "name":
                if name is not None:
                    put("bare", "")
                name = m[0]
            elif what != "space" and name is not None:
                put("bare", "")
        return None

    def tags(self, text: str) -> list[dict]:
        """The tags in order. in_label: within a label that is open; dynamic: attributes are not all known."""
        out, depth, line, seen = [], 0, 1, 0
        text = self.blanked(text)
        for m in START.finditer(text):
            closing = bool(m[1])
            if not closing and m.start() and OPERAND.match(text[m.start() - 1]):
                continue
            bare = text.startswith(">", m.end())
            read = (m.end() + 1, (), False) if bare else self.attributes(text, m.end())
            if read is None:
                continue
            end, found, shuts = read
            line += text.count("\n", seen, m.start())
            seen = m.start()
            if m[2] in self.labels and not shuts:
                depth = max(0, depth - 1) if closing else depth + 1
            dynamic = not bare and self.dynamic.search(QUOTED.sub('""', text[m.start() + 1 : end])) is not None
            attributes = {self.plain(n): {"kind": k, "value": v} for n, k, v in found}
            out.append({"line": line, "name": m[2], "closing": closing, "in_label": depth > 0, "dynamic": dynamic, "attributes": list(attributes.items())})
        return out


def _attribute_maps(found: list[list[tuple]], attribute):
    """Arrow's maps of attributes, a list of (name, {kind, value}) each, column by column."""
    import pyarrow as pa

    offsets, n = [0], 0
    for attributes in found:
        n += len(attributes)
        offsets.append(n)
    flat = [x for attributes in found for x in attributes]
    values_ = pa.StructArray.from_arrays([pa.array([v[k] for _, v in flat], pa.string()) for k in ("kind", "value")], fields=list(attribute))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([n for n, _ in flat], pa.string()), values_)


def pieces(batch, size: int = PIECE_BYTES):
    """A batch's rows in slices whose second column, texts, has about ``size`` bytes: what is made of a slice
    is let go before the next is read, however many tags its texts have."""
    import pyarrow.compute as pc

    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def with_tags(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, tags): a row a file, a null text without tags."""
    fields = values()
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        lexer = Lexer(fields)
        attribute = pa.struct([("kind", pa.string()), ("value", pa.string())])
        shape = pa.list_(pa.struct([("line", pa.int32()), ("name", pa.string()), ("closing", pa.bool_()), ("in_label", pa.bool_()), ("dynamic", pa.bool_()), ("attributes", pa.map_(pa.string(), attribute))]))
        for batch in (piece for whole in batches for piece in pieces(whole)):
            found = [lexer.tags(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, shape)], names=["key", "tags"])

    return map_batches(files.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, tags {TAGS}").withColumnRenamed("key", key)


def _checked_tags(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, name, in_label, dynamic, labelled, unsure, attributes): a row an opening tag that a check is
    of. labelled: a label of the file names its id; unsure: a label of the file names what is not known."""
    fields = values()
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        lexer = Lexer(fields)
        names = frozenset(fields["image_tags"]) | frozenset(fields["form_controls"])
        fors, aria = fields["label_for_attributes"], fields["aria_hidden_attributes"]
        attribute = pa.struct([("kind", pa.string()), ("value", pa.string())])
        own = lambda a: (a["kind"], a["value"].strip(" "))
        for batch in (piece for whole in batches for piece in pieces(whole)):
            at, out = [], [[] for _ in range(7)]
            for i, t in enumerate(batch.column(1).to_pylist()):
                tags = lexer.tags(t) if t else []
                told = [(t, dict(t["attributes"])) for t in tags]
                named = {own(a[n]) for _, a in told for n in fors if n in a}
                unsure = any(k == "expr" for k, _ in named)
                for tag, a in told:
                    if not tag["closing"] and (tag["name"] in names or any(n in a for n in aria)):
                        at.append(i)
                        for column, v in zip(out, (tag["line"], tag["name"], tag["in_label"], tag["dynamic"], "id" in a and own(a["id"]) in named, unsure, tag["attributes"])):
                            column.append(v)
            kinds = (pa.int32(), pa.string(), *[pa.bool_()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(out, kinds)), _attribute_maps(out[6], attribute)], names=["key", "line", "name", "in_label", "dynamic", "labelled", "unsure", "attributes"])

    schema = f"key {kind}, line int, name string, in_label boolean, dynamic boolean, labelled boolean, unsure boolean, attributes map<string,struct<kind:string,value:string>>"
    return map_batches(files.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema).withColumnRenamed("key", key)


def _literal(a: Column) -> Column:
    return F.when(a.kind != "expr", F.lower(F.trim(a.value)))


def states() -> Column:
    """Of a row of _checked_tags: an array of (check, state): hit, fine, or unknown."""
    v = values()
    attributes, dynamic = F.col("attributes"), F.col("dynamic")
    has = lambda *names: functools.reduce(Column.__or__, (attributes[n].isNotNull() for n in names))
    one_of = lambda field: F.col("name").isin(*v[field])
    told = lambda check, state: F.struct(F.lit(check).alias("check"), state.alias("state"))
    kind, ident = attributes["type"], attributes["id"]

    image = F.when(has(*v["alt_attributes"]), "fine").when(dynamic, "unknown").otherwise("hit")
    named = has(*v["name_attributes"]) | F.col("in_label") | F.col("labelled")
    unsure = dynamic | F.coalesce(kind.kind == "expr", F.lit(False)) | (ident.isNotNull() & ((ident.kind == "expr") | F.col("unsure")))
    control = F.when(named, "fine").when(unsure, "unknown").otherwise("hit")
    nameless = F.coalesce(_literal(kind).isin(*v["unnamed_input_types"]), F.lit(False))

    aria = F.coalesce(*(attributes[n] for n in v["aria_hidden_attributes"]))
    word = F.lower(F.btrim(F.btrim(F.btrim(aria.value), F.lit("{}")), F.lit(" \"'\t\n")))
    is_hidden = F.when(aria.kind == "bare", True).when(word.isin("true", "false"), word == "true").when(aria.kind != "expr", False)
    tab = attributes["tabindex"]
    number = F.regexp_extract(tab.value, r"^\s*\{?\s*[\"']?\s*(-?\d+)\s*[\"']?\s*\}?\s*$", 1)
    native = (one_of("focusable_tags") | (one_of("focusable_with_href") & has("href"))) & ~(one_of("form_controls") & F.coalesce(_literal(kind) == "hidden", F.lit(False)))
    off = attributes["disabled"]
    disabled = F.when(off.isNull(), False).when((off.kind != "expr") | (F.replace(off.value, F.lit(" "), F.lit("")) == "{true}"), True)
    focusable = F.when(dynamic, None).when(tab.isNotNull(), F.when(number != "", number.cast("int") >= 0)).when(~native, False).otherwise(~disabled)
    hidden = F.when(~is_hidden | ~focusable, "fine").when(is_hidden & focusable, "hit").otherwise("unknown")
    return F.array_compact(F.array(F.when(one_of("image_tags"), told("image", image)), F.when(one_of("form_controls") & ~nameless, told("control", control)), F.when(aria.isNotNull(), told("hidden", hidden))))


def checks(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line, name, check, state) of images, form controls and what is hidden from assistive tools."""
    rows = _checked_tags(files, key, text)
    return rows.select(key, "line", "name", F.explode(states()).alias("c")).select(key, "line", "name", "c.check", "c.state")


def _matches(path: Column, field: str) -> Column:
    return path.rlike(T.any_glob(values()[field]))


def _any(text: Column, field: str) -> Column:
    return functools.reduce(Column.__or__, (text.rlike(p) for p in values()[field]))


def shipped(files: DataFrame) -> DataFrame:
    """Files that are no test and no build output."""
    return files.where(~_matches(F.col("path"), "markup_excluded"))


def markup_files(files: DataFrame) -> DataFrame:
    return shipped(files).where(_matches(F.col("path"), "markup_files"))


def viewports(files: DataFrame) -> DataFrame:
    """(path, state) of entry documents: zoom_disabled, fine, default (its framework sets one) or missing.
    Comments are blanked first."""
    clean = F.col("text")
    for c in values()["comments"]:
        clean = F.regexp_replace(clean, c, " ")
    entry, default = _matches(F.col("path"), "viewport_entries"), _matches(F.col("path"), "viewport_default_entries")
    state = F.when(_any(F.col("clean"), "zoom_disabled"), "zoom_disabled").when(_any(F.col("clean"), "viewport_declarations"), "fine").when(F.col("by_default"), "default").otherwise("missing")
    rows = shipped(files).where((entry | default) & F.col("text").isNotNull()).select("path", clean.alias("clean"), default.alias("by_default"))
    return rows.select("path", state.alias("state"))


def browser_support(files: DataFrame) -> DataFrame:
    """(path, says): files that declare which browsers are supported, or a framework's own default."""
    v, path = values(), F.col("path")
    declared = (_matches(path, "browserslist_files") & _any(F.col("text"), "browserslist_lines")) | functools.reduce(Column.__or__, (path.rlike(T.glob_regex(g)) & F.col("text").rlike(r) for g, _, r in (x.partition("=") for x in v["browser_support"])))
    says = F.when(declared, "declared")
    for name, _, glob in (x.partition("=") for x in v["browser_support_default_entries"]):
        says = says.when(path.rlike(T.glob_regex(glob)), name)
    return shipped(files).where("text is not null").select("path", says.alias("says")).where("says is not null")
