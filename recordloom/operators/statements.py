"""Program text as arrays of statements, and the flow through each paragraph.

A procedure division is cut once: comments go, literals become ``@`` (a called
name ``@NAME``), white space one blank, and a cut comes before each word that
begins a statement or a conditional phrase. A statement's first word is its verb;
one that ends a sentence keeps its period. Everything else looks at words of the
statements, never at the text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# words that begin a statement: fixed values
VERBS = (
    "ACCEPT", "ADD", "CALL", "CANCEL", "CLOSE", "COMPUTE", "CONTINUE", "COPY", "DELETE", "DISPLAY", "DIVIDE", "ELSE", "EVALUATE", "EXEC",
    "EXIT", "GENERATE", "GO", "GOBACK", "IF", "INITIALIZE", "INSPECT", "MERGE", "MOVE", "MULTIPLY", "OPEN", "PERFORM", "READ", "RELEASE",
    "RETURN", "REWRITE", "SEARCH", "SET", "SORT", "START", "STOP", "STRING", "SUBTRACT", "UNSTRING", "WHEN", "WRITE",
)
# statements that an END- word can close: fixed values
CLOSED = ("ACCEPT", "ADD", "CALL", "COMPUTE", "DELETE", "DISPLAY", "DIVIDE", "EVALUATE", "IF", "MULTIPLY", "PERFORM", "READ", "RETURN", "REWRITE", "SEARCH", "START", "STRING", "SUBTRACT", "UNSTRING", "WRITE")
_PHRASE = r"(?:NOT )?(?:(?:ON )?(?:SIZE ERROR|OVERFLOW|EXCEPTION)|AT END|AT EOP|INVALID)"


def _one_of(words: tuple[str, ...]) -> str:
    """A pattern of these words, by first letter: the engine leaves all of a letter at the first wrong one."""
    letters = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in letters)


# the blank comes first: the engine looks around only where there is one
_CUT = rf" (?:(?<=\. )|(?=(?:{_one_of((*VERBS, *(f'END-{w}' for w in CLOSED)))}|{_PHRASE})(?![A-Z0-9-])))"
_HEADER = r"(?m)^ {7}(?=[A-Za-z0-9-]+(?:\s+SECTION)?\.\s*$)"      # a name alone on a line, in column 8
_NAME = r"[A-Z0-9][A-Z0-9-]*"
_TITLE = rf"^({_NAME})(?:\s+SECTION)?\.[ \t]*(?:\r?\n|$)"
# kinds of edges: fixed values
SEQUENTIAL, TRUE_BRANCH, FALSE_BRANCH, FALLTHROUGH = "SEQUENTIAL", "TRUE_BRANCH", "FALSE_BRANCH", "FALLTHROUGH"
PERFORM, PERFORM_THRU, RETURN, GOTO, CALL, EXIT, UNRESOLVED, LOOP = "PERFORM", "PERFORM_THRU", "RETURN", "GOTO", "CALL", "EXIT", "UNRESOLVED", "LOOP"
END = -1        # in place of a statement's number: behind the paragraph


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value worked out once: inside the functions on arrays, an expression that stands
    in several places is worked out in each of them."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def code(text: Column) -> Column:
    """The text in capitals, without comment lines."""
    return once(F.upper(text), lambda upper: F.when(upper.contains("*"), F.regexp_replace(upper, r"(?m)^.{6}\*.*$", "")).otherwise(upper))


def division(text: Column) -> Column:
    """What follows the procedure division's header."""
    return F.regexp_extract(code(text), r"(?s)PROCEDURE\s+DIVISION[^.]*\.(.*)$", 1)


def statements(body: Column) -> Column:
    """The statements of some procedure text, in order."""
    def quoted(x: Column) -> Column:
        found = F.regexp_replace(x, r"""(CALL\s+)["']([A-Z0-9-]+)["']|'[^']*'|"[^"]*\"""", "$1@$2")
        return F.when(x.contains("'") | x.contains('"'), found).otherwise(x)

    plain = F.trim(F.regexp_replace(once(body, quoted), r"[\s,;]+", " "))
    plain = once(plain, lambda x: F.when(x.contains("EXEC "), F.regexp_replace(x, r"EXEC .*?END-EXEC", "EXEC")).otherwise(x))
    # cuts are marked first, by a line's end, of which none is left: a pattern to split at is compiled for each text
    return F.filter(F.split(F.regexp_replace(plain, _CUT, "\n"), "\n"), lambda x: x != "")


def verb(statement: Column) -> Column:
    return F.rtrim(F.substring_index(statement, " ", 1), F.lit("."))


def paragraphs(text: Column) -> Column:
    """Array of (paragraph, statements); what stands ahead of the first header is named PROCEDURE."""
    parts = F.filter(F.split(division(text), _HEADER), lambda x: ~x.rlike(r"^\s*$"))
    titled = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, _TITLE, 1).alias("name"), x.alias("body")))
    return F.transform(titled, lambda x: F.struct(
        F.when(x["name"] == "", "PROCEDURE").otherwise(x["name"]).alias("paragraph"),
        statements(F.when(x["name"] == "", x["body"]).otherwise(F.regexp_replace(x["body"], _TITLE, ""))).alias("statements")))


def inline(statement: Column) -> Column:
    """A PERFORM whose body follows it, instead of a paragraph's name."""
    return statement.rlike(r"^PERFORM(?: (?:UNTIL|VARYING|WITH|TEST|FOREVER)| [A-Z0-9-]+(?:\([^)]*\))? TIMES|\.?$)")


def leaves(statement: Column) -> Column:
    """Nothing that follows is reached from here."""
    return statement.rlike(r"^(?:STOP RUN|GOBACK|EXIT (?:PROGRAM|PERFORM|PARAGRAPH|SECTION))\.?$")


def jumps(statement: Column) -> Column:
    return statement.startswith("GO ") & ~statement.contains(" DEPENDING ")


_EDGES = "array<struct<s:int,t:int,kind:string>>"
_FRAMES = "array<struct<kind:string,join:int,alt:int,whens:array<int>,other:boolean>>"


def flow(array: Column) -> Column:
    """Edges (s, t, kind) between the statements of a paragraph, by their numbers from 1.

    The statements are folded from the last to the first, so what follows is
    known at each. A frame is an open block: what closes it, where both ways
    join, and the other way. A sentence's end closes all that is open in it.
    """
    numbered = F.reverse(F.transform(array, lambda x, i: F.struct(
        (i + 1).alias("k"), verb(x).alias("verb"), x.alias("text"), x.endswith(".").alias("last"))))
    edge = lambda s, t, kind: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"), F.lit(kind).alias("kind"))
    frame = lambda kind, join, alt, whens=None, other=None: F.struct(
        kind.alias("kind"), join.cast("int").alias("join"), alt.cast("int").alias("alt"), (F.array().cast("array<int>") if whens is None else whens).alias("whens"),
        (F.lit(False) if other is None else other).alias("other"))
    no_edges, no_frames = F.array().cast(_EDGES), F.array().cast(_FRAMES)

    def step(state: Column, st: Column) -> Column:
        k, name, nxt = st["k"], st["verb"], state["next"]
        after = F.when(st["last"], nxt).otherwise(state["after"])
        stack = F.when(st["last"], no_frames).otherwise(state["stack"])
        top = F.get(stack, F.size(stack) - 1)
        below = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        open_ = F.coalesce(top["kind"], F.lit(""))
        join = F.coalesce(top["join"], after)
        own = lambda kind: open_ == kind
        block = F.when(name == "SEARCH", "EVALUATE").otherwise(name)
        else_here = own("IF") & (top["alt"] == END)
        when_here = own("EVALUATE")
        phrase = st["text"].rlike(rf"^{_PHRASE}(?![A-Z0-9-])")
        done = lambda edges, stack, nxt=k: F.struct(nxt.cast("int").alias("next"), after.cast("int").alias("after"), name.alias("before"), stack.alias("stack"), F.concat(state["edges"], edges).alias("edges"))
        one = lambda *e: F.array(*e)
        on = edge(k, nxt, SEQUENTIAL)
        closed = F.regexp_replace(F.substring(name, 5, 30), "^SEARCH$", "EVALUATE")
        return (
            F.when(name == "ELSE", done(one(edge(k, nxt, FALSE_BRANCH)), F.concat(F.when(else_here, below).otherwise(stack), F.array(frame(F.lit("IF"), join, k))), join))
            .when(name == "IF", F.when(own("IF"), done(one(edge(k, nxt, TRUE_BRANCH), edge(k, F.when(top["alt"] == END, join).otherwise(top["alt"]), FALSE_BRANCH)), below))
                  .otherwise(done(one(edge(k, nxt, TRUE_BRANCH), edge(k, join, FALSE_BRANCH)), stack)))
            .when(name == "WHEN", done(
                one(edge(k, F.when(state["before"] == "WHEN", k + 1).otherwise(nxt), SEQUENTIAL)),
                F.concat(F.when(when_here, below).otherwise(stack), F.array(frame(
                    F.lit("EVALUATE"), join, F.lit(END), F.concat(F.when(when_here, top["whens"]).otherwise(F.array().cast("array<int>")), F.array(k.cast("int"))),
                    (when_here & top["other"]) | st["text"].startswith("WHEN OTHER")))), join))
            .when(block == "EVALUATE", done(
                F.concat(F.when(when_here, F.transform(top["whens"], lambda w: edge(k, w, TRUE_BRANCH))).otherwise(no_edges),
                         F.when(when_here & top["other"], no_edges).otherwise(one(edge(k, join, FALSE_BRANCH)))), F.when(when_here, below).otherwise(stack)))
            .when(name.startswith("END-"), done(one(on), F.concat(stack, F.array(frame(closed, k, F.lit(END))))))
            .when(phrase, done(one(edge(k, nxt, TRUE_BRANCH), edge(k, join, FALSE_BRANCH)), stack))
            .when(own("PERFORM") & (name == "PERFORM") & inline(st["text"]), done(one(edge(k, nxt, TRUE_BRANCH), edge(k, join, FALSE_BRANCH), edge(join, k, LOOP)), below))
            .when(jumps(st["text"]) | leaves(st["text"]), done(no_edges, stack))
            .when(name == "CALL", done(one(on, edge(k, nxt, RETURN)), F.when(own("CALL"), below).otherwise(stack)))
            .when(name == "PERFORM", done(one(on, edge(k, nxt, RETURN)), stack))
            .otherwise(done(one(on), F.when(open_ == name, below).otherwise(stack))))

    start = F.struct(F.lit(END).alias("next"), F.lit(END).alias("after"), F.lit("").alias("before"), no_frames.alias("stack"), no_edges.alias("edges"))
    return F.aggregate(numbered, start, step, lambda s: s["edges"])


def performed(statement: Column, heads: Column) -> Column:
    """The paragraphs that an out-of-line PERFORM runs, by name: those from one end of THRU to the
    other; both ends, if they do not stand in this order."""
    one = F.regexp_extract(statement, rf"^PERFORM ({_NAME})", 1)
    two = F.regexp_extract(statement, rf"^PERFORM {_NAME} (?:THRU|THROUGH) ({_NAME})", 1)
    a, b = F.array_position(heads, one).cast("int"), F.array_position(heads, two).cast("int")
    span = F.when((a > 0) & (b >= a), F.slice(heads, F.greatest(a, F.lit(1)), F.greatest(b - a + 1, F.lit(0)))).otherwise(F.array(one, two))
    return F.when((one == "") | inline(statement), F.array().cast("array<string>")).when(two == "", F.array(one)).otherwise(span)


def went(statement: Column) -> Column:
    """The paragraphs that a GO TO names."""
    names = F.regexp_extract(F.rtrim(statement, F.lit(".")), rf"^GO (?:TO )?({_NAME}(?: {_NAME})*?)(?: DEPENDING .*)?$", 1)
    return F.when(names == "", F.array().cast("array<string>")).otherwise(F.split(names, " "))


def called(statement: Column) -> Column:
    """The name of a called program, '' where it is known at run time only."""
    return F.regexp_extract(statement, r"^CALL @([A-Z0-9-]+)", 1)
