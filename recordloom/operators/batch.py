"""Job decks as data: statements, symbols, procedure expansion.

Decks are tables of lines and steps, so a library of jobs is handled in bulk.
Running steps, and deciding which run, is left to whoever schedules the
cluster's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.operators.ordering import scan_by_key
from recordloom.session import cut


# -- statements --------------------------------------------------------------
def statements(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds name, op and operands of each ``//`` line; comments and data drop out."""
    v = F.col(line)
    return (lines.where(v.startswith("//") & ~v.startswith("//*") & v.rlike(r"^//\S*\s+\S+"))
            .withColumns({
                "name": F.upper(F.regexp_extract(v, r"^//(\S*)", 1)),
                "op": F.upper(F.regexp_extract(v, r"^//\S*\s+(\S+)", 1)),
                "operands": F.rtrim(F.regexp_extract(v, r"^//\S*\s+\S+\s+(.*)$", 1)),
            }))


def whole_statements(lines: DataFrame, deck: str, seq: str, line: str = "value") -> DataFrame:
    """(deck, seq, value): control lines with their continuation lines put behind them.

    A line that ends in a comma goes on with the next control line, if that has
    no name; comments between them do not count. ``seq`` is that of the first.
    """
    v = F.col(line)
    control = lines.where(v.startswith("//") & ~v.startswith("//*")).select(deck, seq, line)
    after = scan_by_key(control, [deck], seq, last={"_prev": v})
    goes_on = F.coalesce(F.rtrim("_prev").endswith(","), F.lit(False)) & v.rlike(r"^//\s")
    marked = after.select(deck, seq, line, goes_on.alias("_on"))
    headed = scan_by_key(marked, [deck], seq, last={"_head": F.when(~F.col("_on"), F.col(seq))})
    piece = F.struct(F.col(seq).alias("at"), F.when(F.col("_on"), F.ltrim(F.substring(v, F.lit(3), F.length(v)))).otherwise(F.rtrim(v)).alias("text"))
    start = F.when(F.col("_on"), F.col("_head")).otherwise(F.col(seq)).alias(seq)
    joined = headed.groupBy(deck, start).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    return joined.select(deck, seq, F.array_join(F.transform("_p", lambda x: F.rtrim(x["text"])), "").alias(line))


def step_data_sets(lines: DataFrame, deck: str, seq: str, line: str = "value") -> DataFrame:
    """DD statements with the step they belong to: deck, step, dd, dsn, disp.

    A DD without a name is concatenated to the one before it and has its name.
    """
    st = statements(whole_statements(lines, deck, seq, line), line)
    owner = F.when(F.col("op") == "EXEC", F.col("name"))
    own = F.when((F.col("op") == "DD") & (F.col("name") != ""), F.col("name"))
    placed = scan_by_key(st, [deck], seq, last={"step": owner, "_dd": own})
    ops = F.col("operands")
    return placed.where(F.col("op") == "DD").select(
        deck, "step", F.when(F.col("name") == "", F.col("_dd")).otherwise(F.col("name")).alias("dd"), parameter(ops, "DSN").alias("dsn"), parameter(ops, "DISP").alias("disp"))


def inline_data(lines: DataFrame, deck: str, seq: str, line: str = "value") -> DataFrame:
    """The lines that follow ``DD *`` up to the next control line: deck, seq, dd, value."""
    v = F.col(line)
    control = v.startswith("//") | v.startswith("/*")
    opens = F.when(v.rlike(r"^//\S*\s+DD\s+\*"), F.upper(F.regexp_extract(v, r"^//(\S*)", 1))).otherwise("")
    placed = scan_by_key(lines, [deck], seq, last={"_open": F.when(control, opens)})
    return placed.where(~control & (F.coalesce("_open", F.lit("")) != "")).select(
        deck, seq, F.col("_open").alias("dd"), F.col(line).alias("value"))


def parameter(operands: Column, name: str) -> Column:
    """One keyword operand: PGM=, DSN=, COND=(...); null where absent."""
    got = F.regexp_extract(operands, rf"(?i)(?:^|,)\s*{name}=(\((?:[^()]|\([^()]*\))*\)|'[^']*'|[^,\s]*)", 1)
    return F.nullif(F.regexp_replace(got, "^'|'$", ""), F.lit(""))


def substitute(text: Column, symbols: Column) -> Column:
    """``&NAME.`` and ``&NAME`` from a map column; ``&&TEMP`` names stay.

    Longer names go first, so that one symbol never eats the start of another.
    """
    hidden = F.replace(text, F.lit("&&"), F.lit("\u0001"))
    names = F.array_sort(F.map_keys(symbols), lambda a, b: F.length(b) - F.length(a))
    done = F.aggregate(names, hidden, lambda acc, n: F.replace(
        F.replace(acc, F.concat(F.lit("&"), n, F.lit(".")), symbols[n]), F.concat(F.lit("&"), n), symbols[n]))
    return F.replace(done, F.lit("\u0001"), F.lit("&&"))


def unresolved(text: Column) -> Column:
    """Symbols left after substitution."""
    return F.regexp_extract_all(F.replace(text, F.lit("&&"), F.lit("")), F.lit(r"&([A-Z@#$][A-Z0-9@#$]*)"), F.lit(1))


def expand_procedures(steps: DataFrame, procedures: DataFrame, overrides: DataFrame) -> DataFrame:
    """EXEC of a procedure becomes its steps, with DD overrides put in.

    ``steps``: job, step_no, step, pgm, proc. ``procedures``: proc, proc_no,
    proc_step, proc_pgm, dd, dsn (a row per DD). ``overrides``: job, step,
    proc_step, dd, dsn. Gives job, step_no, proc_no, step, pgm, dd, dsn.
    """
    new = overrides.select("job", "step", "proc_step", "dd", F.col("dsn").alias("_dsn"))
    inner = (steps.where(F.col("proc").isNotNull()).join(procedures, "proc")
             .join(new, ["job", "step", "proc_step", "dd"], "left")
             .select("job", "step_no", "proc_no",
                     F.concat_ws(".", "step", "proc_step").alias("step"), F.col("proc_pgm").alias("pgm"),
                     "dd", F.coalesce("_dsn", "dsn").alias("dsn")))
    plain = steps.where(F.col("proc").isNull()).select(
        "job", "step_no", F.lit(0).alias("proc_no"), "step", "pgm",
        F.lit(None).cast("string").alias("dd"), F.lit(None).cast("string").alias("dsn"))
    return plain.unionByName(inner)


# -- decks as text -----------------------------------------------------------
MOST_NESTED = 15         # procedures within procedures; more is an error, never a silent stop


def symbols_of(text: Column) -> Column:
    """The symbols that a text names, each once; ``&&`` names are none."""
    return F.array_distinct(F.regexp_extract_all(F.replace(F.upper(text), F.lit("&&"), F.lit("")), F.lit(r"&([A-Z@#$][A-Z0-9@#$_]*)"), F.lit(1)))


def assignments(operands: Column) -> Column:
    """NAME=VALUE pairs of a SET, PROC or EXEC as a map; PGM, PROC and COND are no symbols."""
    pairs = F.regexp_extract_all(operands, F.lit(r"(?:^|,)\s*([A-Za-z@#$][A-Za-z0-9@#$_]*=(?:'[^']*'|\([^()]*\)|[^,\s]*))"), F.lit(1))
    named = F.transform(pairs, lambda x: F.struct(F.upper(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(F.regexp_replace(x, "^[^=]*=", ""), "^'|'$", "").alias("value")))
    last = F.filter(named, lambda x: ~x["key"].isin("PGM", "PROC", "COND"))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(last, lambda x: x["key"])), lambda k: F.element_at(F.filter(last, lambda x: x["key"] == k), -1)))


def _in_force(rows: DataFrame, sets: DataFrame, deck: str, at: str, text: str) -> DataFrame:
    """``rows`` with _set, a map: what the symbols in ``text`` were last SET to ahead of ``at``.

    Uses and SETs of a symbol stand in one sequence, along which the value is carried.
    """
    uses = rows.select(deck, F.col(at).alias("_at"), F.explode(symbols_of(F.col(text))).alias("symbol")).distinct()
    both = uses.select(deck, "symbol", (F.col("_at") * 2).alias("_order"), F.lit(None).cast("string").alias("value")).unionByName(
        sets.select(deck, "symbol", (F.col("_at") * 2 + 1).alias("_order"), "value"))
    found = scan_by_key(both, [deck, "symbol"], "_order", last={"_now": F.col("value")}).where("_order % 2 = 0 AND _now IS NOT NULL")
    maps = found.groupBy(deck, F.expr("_order DIV 2").alias(at)).agg(F.map_from_entries(F.collect_list(F.struct("symbol", "_now"))).alias("_set"))
    return rows.join(maps, [deck, at], "left").withColumn("_set", F.coalesce("_set", F.create_map().cast("map<string,string>")))


def set_symbols(st: DataFrame, deck: str, seq: str) -> DataFrame:
    """(deck, symbol, _at, value) of the SET statements. A value that names symbols gets what those held by then."""
    sets = cut(st.where("op = 'SET'").select(deck, F.col(seq).alias("_at"), F.explode(assignments(F.col("operands"))).alias("symbol", "value")))
    for _ in range(MOST_NESTED):
        told = _in_force(sets, sets, deck, "_at", "value").withColumn("_new", substitute(F.col("value"), F.col("_set")))
        told = cut(told)
        if told.where("_new <> value").isEmpty():
            return sets
        sets = told.select(deck, "_at", "symbol", F.col("_new").alias("value"))
    raise RuntimeError(f"symbols name one another more than {MOST_NESTED} deep")


def expanded(lines: DataFrame, deck: str, seq: str, line: str = "value") -> DataFrame:
    """(deck, root, path, level, step, op, dd, operands): the EXEC and DD statements that decks come to.

    Symbols are put in as they were SET ahead of the statement; EXEC of a
    procedure of the deck (PROC to PEND) becomes its statements, in turn if it
    runs others, with the values on EXEC ahead of those on PROC ahead of SET.
    Steps are named STEP.PROCSTEP. A DD named PROCSTEP.DD behind such an EXEC
    stands for the procedure's own, the outermost first. ``root`` is the EXEC of
    the deck itself, ``path`` the numbers of all that led here.
    """
    st = cut(statements(whole_statements(lines, deck, seq, line), line))
    o = F.col("op")
    named = F.when((o == "DD") & (F.col("name") != ""), F.col("name"))
    placed = scan_by_key(st, [deck], seq, last={
        "_proc": F.when(o == "PROC", F.col("name")).when(o == "PEND", ""), "_step": F.when(o == "EXEC", F.col("name")), "_exec": F.when(o == "EXEC", F.col(seq)), "_dd": named})
    own = lambda c, value: F.when(o == "EXEC", F.col(value)).otherwise(F.col(c))
    placed = cut(placed.where(o.isin("EXEC", "DD", "PROC")).select(
        deck, F.col(seq).alias("_at"), "op", F.coalesce("_proc", F.lit("")).alias("_proc"), own("_step", "name").alias("step"), own("_exec", seq).alias("root"),
        F.coalesce(named, "_dd").alias("dd"), "operands", "name"))
    sets = set_symbols(st, deck, seq)
    defaults = placed.where("op = 'PROC'").select(deck, F.col("name").alias("_called"), assignments(F.col("operands")).alias("_defaults"))
    bodies = placed.where("op <> 'PROC' AND _proc <> ''").select(deck, F.col("_proc").alias("_called"), F.col("_at").alias("_body_at"), F.col("op").alias("_op"), F.col("step").alias("_body_step"),
                                                               F.col("dd").alias("_body_dd"), F.col("operands").alias("_body"))
    inside = cut(defaults.join(bodies, [deck, "_called"]))

    def put_in(rows: DataFrame) -> DataFrame:
        told = _in_force(rows, sets, deck, "root", "operands")
        args = F.col("_args")
        outer = F.map_filter("_set", lambda k, v: ~F.array_contains(F.map_keys(args), k))
        return told.withColumn("operands", substitute(F.col("operands"), F.map_concat(outer, args))).drop("_set")

    none = F.create_map().cast("map<string,string>")
    level = put_in(placed.where("op <> 'PROC' AND _proc = ''").select(
        deck, "root", F.array("_at").alias("path"), F.lit("").alias("prefix"), "step", "op", "dd", "operands", none.alias("_args"))).withColumn("level", F.lit(0))
    level, every = cut(level), None
    for depth in range(1, MOST_NESTED + 2):
        target = F.upper(F.coalesce(parameter(F.col("operands"), "PROC"), F.nullif(F.regexp_extract("operands", r"^([A-Za-z@#$][A-Za-z0-9@#$]*)(?:,|$)", 1), F.lit(""))))
        calls = level.where("op = 'EXEC'").withColumn("_called", target).join(inside, [deck, "_called"])
        known = inside.select(deck, "_called").distinct()
        run = level.withColumn("_called", F.when(o == "EXEC", target)).join(known.withColumn("_is", F.lit(True)), [deck, "_called"], "left")
        here = run.where("_is IS NULL").select(deck, "root", "path", "level", "prefix", "step", "op", "dd", "operands")
        every = here if every is None else every.unionByName(here)
        given = assignments(F.col("operands"))
        args = F.map_concat(F.map_filter("_defaults", lambda k, v: ~F.array_contains(F.map_keys(F.col("_given")), k)), F.col("_given"))
        below = calls.withColumn("_given", given).select(
            deck, "root", F.concat("path", F.array("_body_at")).alias("path"), F.concat("prefix", "step", F.lit(".")).alias("prefix"), F.col("_body_step").alias("step"), F.col("_op").alias("op"),
            F.col("_body_dd").alias("dd"), F.col("_body").alias("operands"), args.alias("_args"))
        level = cut(put_in(below).withColumn("level", F.lit(depth)))
        if level.isEmpty():
            break
    else:
        raise RuntimeError(f"procedures run one another more than {MOST_NESTED} deep")
    over = F.col("dd").contains(".")
    out = every.select(
        deck, "root", "path", "level", F.concat("prefix", "step", F.when((o == "DD") & over, F.concat(F.lit("."), F.substring_index("dd", ".", 1))).otherwise("")).alias("step"),
        "op", F.when(o == "DD", F.substring_index("dd", ".", -1)).alias("dd"), "operands")
    first = out.groupBy(deck, "root", "step", "op", "dd").agg(F.min("level").alias("level"))
    same = [out[c].eqNullSafe(first[c]) for c in (deck, "root", "step", "op", "dd", "level")]
    return out.join(first, same, "left_semi")


# -- utilities ---------------------------------------------------------------
def copy_dataset(spark, source: str, target: str) -> None:
    """Copy a line file, line for line."""
    spark.read.text(source).write.mode("overwrite").text(target)


def delete_dataset(spark, name: str) -> bool:
    return bool(spark.sql(f"DROP TABLE IF EXISTS {name}") is not None)


def define_cluster(spark, name: str, layout, fmt: str = "parquet") -> None:
    """Create an empty table for a keyed data set from its layout."""
    spark.createDataFrame([], layout.schema()).write.mode("errorifexists").format(fmt).saveAsTable(name)
