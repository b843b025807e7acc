"""Call, control-flow and data-flow edges from program text, and what they reach.

Programs come as a table (program, text), a row a program; its edges are worked
out within the row, from its statements (`statements.py`), so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.operators.statements import (
    CALL, END, EXIT, FALLTHROUGH, GOTO, PERFORM, PERFORM_THRU, RETURN, UNRESOLVED, called, code, division, flow, leaves, once, paragraphs as parts_of, performed, statements, verb, went,
)
from recordloom.session import cut

# kinds of edges: fixed values
ASSIGNS, DERIVES_FROM, CONDITIONAL_ON = "ASSIGNS", "DERIVES_FROM", "CONDITIONAL_ON"
CONSUMES, PRODUCES, CALLS_WITH, SHARED_STORAGE, USES = "CONSUMES", "PRODUCES", "CALLS_WITH", "SHARED_STORAGE", "USES"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _word(*words: str) -> str:
    """One of these words, not inside a longer one such as END-IF.

    The literal comes first: the engine skips on at the first wrong letter,
    and looks back only once the word is there.
    """
    either = words[0] if len(words) == 1 else "(?:" + "|".join(words) + ")"
    return rf"{either}(?<![A-Z0-9-]{either})"


def _edges(staged: DataFrame, keep: str, edges: Column, fields: list[str]) -> DataFrame:
    """One row per edge. The outer explode saves building the array twice."""
    flat = staged.select(keep, edges.alias("_all")).select(keep, F.explode_outer("_all").alias("_e"))
    return flat.where(F.col("_e").isNotNull()).select(keep, *[f"_e.{f}" for f in fields])


# -- calls -------------------------------------------------------------------
def call_edges(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(caller, callee, kind): literal targets are static, names dynamic."""
    calls = F.filter("_statements", lambda st: st.startswith("CALL "))
    found = F.transform(calls, lambda st: F.struct(F.regexp_extract(st, r"^CALL @?([A-Z0-9-]+)", 1).alias("callee"), F.when(called(st) != "", "static").otherwise("dynamic").alias("kind")))
    staged = programs.select(F.col(program).alias("caller"), statements(division(F.col(text))).alias("_statements"))
    return _edges(staged, "caller", F.array_distinct(F.filter(found, lambda x: x["callee"] != "")), ["callee", "kind"])


def roots(programs: DataFrame, edges: DataFrame, program: str = "program") -> DataFrame:
    """Programs nothing calls by name."""
    called = edges.where(F.col("kind") == "static").select(F.col("callee").alias(program)).distinct()
    return programs.select(program).distinct().join(called, program, "left_anti")


def dynamic_callers(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind") == "dynamic").select("caller").distinct()


def uncovered(required: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Dependencies named somewhere and found nowhere, with their number of users."""
    return required.groupBy(name).agg(F.count(F.lit(1)).alias("uses")).join(present.select(name).distinct(), name, "left_anti")


def copybook_uses(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    names = _all(code(F.col(text)), rf"""{_word("COPY")}\s+["']?([A-Z0-9-]+)""")
    found = programs.select(F.col(program).alias("program"), F.array_distinct(names).alias("_all"))
    return found.select("program", F.explode_outer("_all").alias("copybook")).where(F.col("copybook").isNotNull())


# -- control flow ------------------------------------------------------------
def _named(target: Column, kind: Column | str) -> Column:
    return F.struct(target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


_TARGETS = "array<struct<target:string,kind:string>>"


def _leads(st: Column, heads: Column) -> Column:
    """Named targets of one statement: paragraphs performed or gone to, programs called, the way out."""
    none = F.array().cast(_TARGETS)
    name = called(st)
    return (F.when(st.startswith("PERFORM "), F.transform(performed(st, heads), lambda t: _named(t, PERFORM)))
            .when(st.startswith("GO "), F.transform(went(st), lambda t: _named(t, GOTO)))
            .when(st.startswith("CALL ") & (name != ""), F.array(_named(name, CALL)))
            .when(leaves(st), F.array(_named(F.lit("EXIT"), EXIT)))
            .otherwise(none))


def _staged(programs: DataFrame, program: str, text: str) -> DataFrame:
    parts = programs.select(F.col(program).alias("program"), parts_of(F.col(text)).alias("_parts"))
    return parts.select("program", "_parts", F.transform("_parts", lambda p: p["paragraph"]).alias("_heads"))


def paragraphs(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, n, paragraph, statements), in source order from zero."""
    return programs.select(F.col(program).alias("program"), F.posexplode(parts_of(F.col(text))).alias("n", "_p")).select("program", "n", "_p.paragraph", "_p.statements")


def control_flow(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, source, target, kind) between paragraphs.

    FALLTHROUGH goes to the next paragraph if some way through the paragraph
    reaches its end (`statement_flow`). PERFORM THRU leads to each paragraph of
    its range, GO TO .. DEPENDING ON to each one that it lists.
    """
    heads = F.col("_heads")

    def edges(p: Column, i: Column) -> Column:
        behind = F.coalesce(F.get(heads, i + 1), F.lit("EXIT"))
        # the way through is worked out only where some statement goes elsewhere
        stays = ~F.exists(p["statements"], lambda st: st.startswith("GO") | st.startswith("STOP ") | st.startswith("EXIT "))
        through = stays | F.exists(flow(p["statements"]), lambda e: e["t"] == END)
        found = F.concat(F.flatten(F.transform(p["statements"], lambda st: _leads(st, heads))),
                         F.when(through, F.array(_named(behind, FALLTHROUGH))).otherwise(F.array().cast(_TARGETS)))
        return F.transform(F.array_distinct(found), lambda e: F.struct(p["paragraph"].alias("source"), e["target"].alias("target"), e["kind"].alias("kind")))

    return _edges(_staged(programs, program, text), "program", F.flatten(F.transform("_parts", edges)), ["source", "target", "kind"])


def statement_flow(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, source, target, kind) between statements, named PARAGRAPH:n from 1, and paragraphs.

    A paragraph falls through to its first statement; its last leads to the next
    paragraph, or EXIT. IF has a TRUE_BRANCH to what follows and a FALSE_BRANCH to
    its ELSE or to where both ways join: END-IF, or what stands behind the sentence.
    EVALUATE has a TRUE_BRANCH to each WHEN, and a FALSE_BRANCH to the join if no
    WHEN OTHER is there. Conditional phrases (AT END, ON SIZE ERROR, ..) branch
    like IF; an inline PERFORM too, with a LOOP back from its end. PERFORM of a
    paragraph leads there (PERFORM_THRU with a range), the last paragraph of which
    leads back (RETURN). CALL leads to the called program, which leads back.
    Paragraphs that are not there, and programs named at run time, give UNRESOLVED
    edges to the statement itself. EXIT PARAGRAPH, SECTION and PERFORM count as the
    way out; a lone EXIT does nothing.
    """
    heads = F.col("_heads")
    kinds = "array<struct<source:string,target:string,kind:string>>"
    full = lambda s, t, k: F.struct(s.alias("source"), t.alias("target"), (F.lit(k) if isinstance(k, str) else k).alias("kind"))
    none = F.array().cast(kinds)
    known = lambda name: F.array_contains(heads, name)

    def edges(p: Column, i: Column) -> Column:
        name, sts = p["paragraph"], p["statements"]
        behind = F.coalesce(F.get(heads, i + 1), F.lit("EXIT"))
        node = lambda k: F.when(k == END, behind).otherwise(F.concat(name, F.lit(":"), k.cast("string")))

        def inner(e: Column) -> Column:
            st = F.get(sts, e["s"] - 1)
            ends = performed(st, heads)
            last = F.when(st.startswith("CALL "), F.coalesce(F.nullif(called(st), F.lit("")), F.lit(""))).otherwise(F.coalesce(F.element_at(ends, -1), F.lit("")))
            back = (last != "") & (st.startswith("CALL ") | known(last))
            return (F.when(e["kind"] != RETURN, F.array(full(node(e["s"]), node(e["t"]), e["kind"])))
                    .when(back, F.array(full(last, node(e["t"]), RETURN))).otherwise(none))

        def leads(st: Column, k: Column) -> Column:
            here = node(k + 1)
            run = performed(st, heads)
            thru = st.rlike(r"^PERFORM [A-Z0-9-]+ (?:THRU|THROUGH) ")
            first = F.element_at(run, 1)
            perform = F.when(F.size(run) == 0, none).when(known(first) & known(F.element_at(run, -1)), F.array(full(here, first, F.when(thru, PERFORM_THRU).otherwise(PERFORM)))).otherwise(F.array(full(here, here, UNRESOLVED)))
            go = F.transform(went(st), lambda t: F.when(known(t), full(here, t, GOTO)).otherwise(full(here, here, UNRESOLVED)))
            call = F.array(F.when(called(st) != "", full(here, called(st), CALL)).otherwise(full(here, here, UNRESOLVED)))
            return (F.when(st.startswith("PERFORM "), perform).when(st.startswith("GO "), go).when(st.startswith("CALL "), call)
                    .when(leaves(st), F.array(full(here, F.lit("EXIT"), EXIT))).otherwise(none))

        first = F.array(full(name, F.when(F.size(sts) == 0, behind).otherwise(node(F.lit(1))), FALLTHROUGH))
        return F.array_distinct(F.concat(first, F.flatten(F.transform(flow(sts), inner)), F.flatten(F.transform(sts, leads))))

    return _edges(_staged(programs, program, text), "program", F.flatten(F.transform("_parts", edges)), ["source", "target", "kind"])


# -- data flow ---------------------------------------------------------------
_KINDS = "array<struct<source:string,target:string,kind:string>>"
# words of statements that name no item: fixed values
_OTHER_WORDS = (
    "ALL", "ALPHABETIC", "ALSO", "AND", "ANY", "BY", "COLLATING", "CONTENT", "CORR", "CORRESPONDING", "DELIMITED", "DELIMITER", "EQUAL", "FALSE", "FROM", "GIVING", "GREATER",
    "HIGH-VALUE", "HIGH-VALUES", "IN", "INTO", "IS", "KEY", "LENGTH", "LESS", "LOW-VALUE", "LOW-VALUES", "NEGATIVE", "NEXT", "NOT", "NULL", "NULLS", "NUMERIC", "OF", "OMITTED", "OR",
    "OTHER", "OVERFLOW", "POINTER", "POSITIVE", "QUOTE", "QUOTES", "RECORD", "REFERENCE", "REMAINDER", "ROUNDED", "SENTENCE", "SIZE", "SPACE", "SPACES", "TALLYING", "TEST", "THAN", "THEN",
    "THRU", "TIMES", "TO", "TRUE", "UNTIL", "VALUE", "VARYING", "WITH", "AFTER", "BEFORE", "ZERO", "ZEROES", "ZEROS",
)
# a subscript or a part of an item; after these words a parenthesis groups
_SUBSCRIPT = r"\((?<=[A-Z0-9] ?\()(?<!(?<![A-Z0-9-])(?:AND|OR|NOT|TO|THAN|EQUAL|IS|BY|FROM|UNTIL|ALSO|WHEN|IF|THRU) ?\()[^()]*\)"


def _items(words: Column) -> Column:
    """The items that some words of a statement name; subscripts and qualifiers are no items of their own."""
    part = rf"FUNCTION [A-Z0-9-]+|{_SUBSCRIPT}| (?:OF|IN) [A-Z][A-Z0-9-]*"
    plain = once(words, lambda x: F.when(x.contains("(") | x.contains(" OF ") | x.contains(" IN ") | x.contains("FUNCTION "), F.regexp_replace(x, part, " ")).otherwise(x))
    return F.array_except(F.array_distinct(_all(plain, r"(?<![A-Z0-9@-])([A-Z][A-Z0-9-]*)")), F.array(*[F.lit(w) for w in _OTHER_WORDS]))


def _changes(st: Column, v: Column) -> Column:
    """(sources, targets, kind) of one statement with this verb; null where it gives no item a value."""
    row = lambda sources, targets, kind: F.struct(_items(sources).alias("sources"), _items(targets).alias("targets"), F.lit(kind).alias("kind"))
    between = lambda pattern: F.regexp_extract(st, pattern, 1)
    after = lambda word: F.substring_index(st, word, -1)
    body = F.regexp_replace(st, r"^[A-Z]+", "")
    giving = st.contains(" GIVING ")
    place = F.when(st.startswith("ADD"), after(" TO ")).when(st.startswith("SUBTRACT"), after(" FROM ")).when(st.startswith("MULTIPLY"), after(" BY ")).otherwise(after(" INTO "))
    rest = lambda word: F.substring_index(body, word, 1)
    return (
        F.when(v == "MOVE", row(rest(" TO "), after(" TO "), ASSIGNS))
        .when(v == "COMPUTE", row(between(r"=(.*)$"), rest("="), DERIVES_FROM))
        .when(v.isin("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"), F.when(giving, row(rest(" GIVING "), after(" GIVING "), DERIVES_FROM)).otherwise(row(body, place, DERIVES_FROM)))
        .when(v.isin("READ", "RETURN") & st.contains(" INTO "), row(between(r"^[A-Z]+ ([A-Z0-9-]+)"), after(" INTO "), CONSUMES))
        .when(v.isin("WRITE", "REWRITE", "RELEASE") & st.contains(" FROM "), row(between(r" FROM ([A-Z0-9-]+)"), between(r"^[A-Z]+ ([A-Z0-9-]+)"), ASSIGNS))
        .when((v == "STRING") & st.contains(" INTO "), row(rest(" INTO "), between(r" INTO ([A-Z0-9-]+)"), DERIVES_FROM))
        .when((v == "UNSTRING") & st.contains(" INTO "), row(between(r"^UNSTRING ([A-Z0-9-]+)"), between(r" INTO (.*?)(?: (?:WITH|POINTER|TALLYING)\b.*)?$"), DERIVES_FROM))
        .when((v == "SET") & st.contains(" TO "), row(after(" TO "), rest(" TO "), ASSIGNS)))


def data_flow(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, source, target, kind): what each item's value comes from.

    MOVE, SET and WRITE FROM give ASSIGNS, READ INTO gives CONSUMES; COMPUTE,
    STRING, UNSTRING and ADD/SUBTRACT/MULTIPLY/DIVIDE, with GIVING or in place,
    give DERIVES_FROM; items tested by IF, EVALUATE, WHEN or an inline PERFORM give
    CONDITIONAL_ON for the items that get a value under it, nested ones too, up to
    its end or the end of the sentence. Literals and figurative constants are no items.
    """
    opens = lambda v, st: v.isin("IF", "EVALUATE") | ((v == "PERFORM") & st.rlike(r"^PERFORM (?:UNTIL|VARYING|WITH|TEST)"))
    none = F.array().cast("array<array<string>>")

    def under(state: Column, x: Column) -> Column:
        """Conditions in force, innermost last, and the pairs so far."""
        tests, v, st, change = state["tests"], x["verb"], x["text"], x["change"]
        own = _items(F.regexp_replace(st, r"^[A-Z-]+", ""))
        top = F.coalesce(F.get(tests, F.size(tests) - 1), F.array().cast("array<string>"))
        below = F.slice(tests, 1, F.greatest(F.size(tests) - 1, F.lit(0)))
        now = (F.when(opens(v, st), F.concat(tests, F.array(own)))
               .when((v == "WHEN") & (F.size(tests) > 0), F.concat(below, F.array(F.array_union(top, own))))
               .when(v.isin("END-IF", "END-EVALUATE", "END-PERFORM"), below).otherwise(tests))
        pairs = F.when(change.isNotNull() & (F.size(tests) > 0), F.concat(state["pairs"], _cross(F.flatten(tests), change["targets"], F.lit(CONDITIONAL_ON)))).otherwise(state["pairs"])
        return F.struct(F.when(st.endswith("."), none).otherwise(now).alias("tests"), pairs.alias("pairs"))

    start = F.struct(none.alias("tests"), F.array().cast(_KINDS).alias("pairs"))
    values = F.flatten(F.transform(F.filter("_told", lambda x: x["change"].isNotNull()), lambda x: _cross(x["change"]["sources"], x["change"]["targets"], x["change"]["kind"])))
    tested = F.when(F.exists("_told", lambda x: x["verb"].isin("IF", "EVALUATE", "PERFORM")), F.aggregate("_told", start, under, lambda s: s["pairs"])).otherwise(F.array().cast(_KINDS))
    staged = programs.select(F.col(program).alias("program"), statements(division(F.col(text))).alias("_statements"))
    told = staged.select("program", F.transform("_statements", lambda st: once(verb(st), lambda v: F.struct(v.alias("verb"), st.alias("text"), _changes(st, v).alias("change")))).alias("_told"))
    return _edges(told, "program", F.array_distinct(F.concat(values, tested)), ["source", "target", "kind"])


def _cross(sources: Column, targets: Column, kind: Column) -> Column:
    return F.flatten(F.transform(targets, lambda t: F.transform(sources, lambda s: F.struct(s.alias("source"), t.alias("target"), kind.alias("kind")))))


def file_flow(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, source, target, kind): READ gives CONSUMES from a file to its record, where the text
    declares one (FD and the 01 level behind it); WRITE and REWRITE give PRODUCES from a record to its file."""
    whole = code(F.col(text))
    declared = F.transform(_all(whole, r"(?s)(?<![A-Z0-9-])FD\s+([A-Z0-9-]+.*?\s01\s+[A-Z0-9-]+)", 1), lambda x: F.struct(
        F.regexp_extract(x, r"^([A-Z0-9-]+)", 1).alias("file"), F.regexp_extract(x, r"\s01\s+([A-Z0-9-]+)$", 1).alias("record")))

    def edges(st: Column) -> Column:
        name = F.regexp_extract(st, r"^[A-Z]+ ([A-Z0-9-]+)", 1)
        of = lambda field, out, kind: F.transform(F.filter("_declared", lambda d: d[field] == name), lambda d: F.struct(
            d["file" if kind == CONSUMES else "record"].alias("source"), d[out].alias("target"), F.lit(kind).alias("kind")))
        return (F.when(verb(st).isin("READ", "RETURN"), of("file", "record", CONSUMES)).when(verb(st).isin("WRITE", "REWRITE"), of("record", "file", PRODUCES))
                .otherwise(F.array().cast(_KINDS)))

    staged = programs.select(F.col(program).alias("program"), declared.alias("_declared"), statements(division(F.col(text))).alias("_statements"))
    return _edges(staged, "program", F.array_distinct(F.flatten(F.transform("_statements", edges))), ["source", "target", "kind"])


def storage_flow(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, source, target, kind) from the data division: SHARED_STORAGE from an item to the one that
    redefines it, USES from a condition name (level 88) to the item it tests."""
    data = F.regexp_replace(F.regexp_extract(code(F.col(text)), r"(?s)DATA\s+DIVISION\s*\.(.*?)(?:PROCEDURE\s+DIVISION|$)", 1), r"""'[^']*'|"[^"]*\"""", "@")
    entries = F.filter(F.transform(F.split(data, r"\.(?=\s|$)"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(r"^\d\d? [A-Z0-9]"))
    name = lambda x: F.regexp_extract(x, r"^\d+ ([A-Z0-9-]+)", 1)

    def seen(state: Column, x: Column) -> Column:
        shared = F.regexp_extract(x, r" REDEFINES ([A-Z0-9-]+)", 1)
        is_88 = x.startswith("88 ")
        row = lambda s, t, kind: F.array(F.struct(s.alias("source"), t.alias("target"), F.lit(kind).alias("kind")))
        found = F.when(is_88 & (state["item"] != ""), row(name(x), state["item"], USES)).when(shared != "", row(shared, name(x), SHARED_STORAGE)).otherwise(F.array().cast(_KINDS))
        return F.struct(F.when(is_88, state["item"]).otherwise(name(x)).alias("item"), F.concat(state["edges"], found).alias("edges"))

    start = F.struct(F.lit("").alias("item"), F.array().cast(_KINDS).alias("edges"))
    staged = programs.select(F.col(program).alias("program"), entries.alias("_entries"))
    return _edges(staged, "program", F.array_distinct(F.aggregate("_entries", start, seen, lambda s: s["edges"])), ["source", "target", "kind"])


# -- across programs ---------------------------------------------------------
def _using(st: Column) -> Column:
    """What a CALL hands over, in order: items, and '' for what is no item."""
    words = F.regexp_extract(F.rtrim(st, F.lit(".")), r" USING (.*?)(?: (?:RETURNING|GIVING) .*)?$", 1)
    plain = F.regexp_replace(words, rf"{_SUBSCRIPT}| (?:OF|IN) [A-Z][A-Z0-9-]*|\b(?:BY|REFERENCE|CONTENT|VALUE)\b", "")
    return F.transform(F.filter(F.split(F.trim(plain), " +"), lambda w: w != ""), lambda w: F.when(w.rlike("^[A-Z]") & ~w.isin("OMITTED"), w).otherwise(""))


def call_arguments(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(program, source, target, kind): the items that each called program, or name of one, gets."""
    found = F.filter("_statements", lambda st: st.startswith("CALL ") & st.contains(" USING "))
    edges = F.flatten(F.transform(found, lambda st: F.transform(F.filter(_using(st), lambda w: w != ""), lambda w: F.struct(
        w.alias("source"), F.regexp_extract(st, r"^CALL @?([A-Z0-9-]+)", 1).alias("target"), F.lit(CALLS_WITH).alias("kind")))))
    staged = programs.select(F.col(program).alias("program"), statements(division(F.col(text))).alias("_statements"))
    return _edges(staged, "program", F.array_distinct(edges), ["source", "target", "kind"])


def parameter_flow(programs: DataFrame, program: str = "program", text: str = "text") -> DataFrame:
    """(source_program, source, target_program, target, way): each item that a CALL with a literal name hands
    over, and the called program's parameter in the same place (PROCEDURE DIVISION USING). Parameters are
    shared, so there is a row for either way, IN and OUT; by content or by value there is none out."""
    staged = programs.select(F.col(program).alias("program"), statements(division(F.col(text))).alias("_statements"),
                             F.regexp_extract(code(F.col(text)), r"(?s)PROCEDURE\s+DIVISION\s+USING\s+([^.]*)\.", 1).alias("_parameters"))
    found = F.filter("_statements", lambda st: (called(st) != "") & st.contains(" USING "))
    copied = lambda st: st.rlike(r" USING BY (?:CONTENT|VALUE) ")
    calls = staged.select("program", F.explode(F.transform(found, lambda st: F.struct(called(st).alias("callee"), _using(st).alias("items"), copied(st).alias("copied")))).alias("_c"))
    given = calls.select("program", "_c.callee", "_c.copied", F.posexplode("_c.items").alias("at", "item")).where("item <> ''").distinct()
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.col("_parameters"), r"\b(?:BY|REFERENCE|VALUE)\b", " "), r"[\s,]+", " "))
    taken = staged.where("_parameters <> ''").select(F.col("program").alias("_callee"), F.posexplode(F.split(plain, " ")).alias("_at", "parameter"))
    met = given.join(taken, (F.col("callee") == F.col("_callee")) & (F.col("at") == F.col("_at")))
    into = met.select(F.col("program").alias("source_program"), F.col("item").alias("source"), F.col("callee").alias("target_program"), F.col("parameter").alias("target"), F.lit("IN").alias("way"))
    back = met.where("NOT copied").select(F.col("callee").alias("source_program"), F.col("parameter").alias("source"), F.col("program").alias("target_program"), F.col("item").alias("target"), F.lit("OUT").alias("way"))
    return into.unionByName(back)


def lineage_edges(programs: DataFrame, program: str = "program", text: str = "text", kinds: tuple[str, ...] = (ASSIGNS, DERIVES_FROM, CONSUMES, PRODUCES, SHARED_STORAGE)) -> DataFrame:
    """(source, target) between items of all programs, each named PROGRAM.ITEM: the flow within programs and over their calls."""
    own = data_flow(programs, program, text).unionByName(file_flow(programs, program, text)).unionByName(storage_flow(programs, program, text)).where(F.col("kind").isin(*kinds))
    name = lambda p, i: F.concat(F.col(p), F.lit("."), F.col(i))
    over = parameter_flow(programs, program, text)
    return own.select(name("program", "source").alias("source"), name("program", "target").alias("target")).union(
        over.select(name("source_program", "source"), name("target_program", "target"))).distinct()


# -- reachability ------------------------------------------------------------
def reach(edges: DataFrame, seeds: DataFrame, source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """(node, depth): everything reachable from the seeds, at its least depth.

    Breadth first: each step joins only the newest nodes with the edges, and
    nodes already seen are dropped, so cycles end and no edge is followed
    twice. Each step's nodes are kept on the shared folder.
    """
    links = cut(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct())
    frontier = cut(seeds.select(F.col(node)).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = links.join(frontier.select(F.col(node).alias("_s")), "_s", "left_semi").select(F.col("_t").alias(node)).distinct()
        frontier = cut(step.join(seen.select(node), node, "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def connected(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, part): the smallest id that an id is linked with, through any number of links.

    Each round every id goes to the smallest of its neighbours and on to where
    that one goes; links between what has come together are dropped, the rest
    is carried over to where their ends went. At most half of the ids go on to
    the next round, so a chain of a million takes twenty.
    """
    some = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, label = cut(some), None
    while not edges.isEmpty():
        pairs = edges.select(F.col("b").alias("id"), F.col("a").alias("up")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("up")))
        up = cut(pairs.groupBy("id").agg(F.min("up").alias("up")))
        step = cut(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("to")), "up").select("id", "to"))
        moved = step.select(F.col("id").alias("part"), "to")
        label = step.select("id", F.col("to").alias("part")) if label is None else label.join(moved, "part", "left").select("id", F.coalesce("to", "part").alias("part"))
        label = cut(label)
        left = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("_a")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("_b")), "b").where("_a <> _b")
        edges = cut(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("part")) if label is None else label
