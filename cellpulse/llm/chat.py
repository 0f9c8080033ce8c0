"""Chat formatting by schema fingerprints, DataFrame operations only.

A record's layout is the set of nested field paths that hold a value, such as
`messages[].role`. Each layout is declared once: the paths it needs, those it may have,
and how its turns are read. The hash of a record's sorted paths selects the mapping, so
records of many layouts can share one table; all become turns of role and text, and one
template writes them.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In texts and roles a `<`
followed by any number of `~` and a `|` gets one more `~`, so no marker can appear in
them, and taking one `~` away restores them. In roles a line break becomes `%0A` and a
`%` becomes `%25`. The loss mask covers the texts of assistant turns.

Everything is linear in the record. A record is one row, formatted by one task, as its
digest must be; nothing else is gathered by key.

Defined results: a null role or text inside a turn is empty; a record of no declared
layout gets no turns and a null layout, and is kept; turns with the same number are ordered
by role and text; an empty table gives no rows; other columns are not carried over.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
# Role names of one of the layouts and what they mean.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and SQL for its turns."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may_have: tuple[str, ...] = ()

    def path_sets(self) -> list[str]:
        """Every set of paths a record of this layout can have, as sorted text."""
        return [
            " ".join(sorted(self.needs + extra))
            for n in range(len(self.may_have) + 1)
            for extra in combinations(self.may_have, n)
        ]


def _named_roles(field: str) -> str:
    known = " ".join(f"WHEN '{name}' THEN '{role}'" for name, role in ROLE_NAMES.items())
    return f"CASE {field} {known} ELSE {field} END"


def _pair(user: str, assistant: str) -> str:
    return (
        f"array(named_struct('role', 'user', 'text', {user}),"
        f" named_struct('role', 'assistant', 'text', {assistant}))"
    )


LAYOUTS = (
    Layout(
        "messages",
        ("messages[].role", "messages[].text"),
        "transform(messages, m -> named_struct('role', m.role, 'text', m.text))",
    ),
    Layout(
        "role_content",
        ("messages[].content", "messages[].role"),
        "transform(messages, m -> named_struct('role', m.role, 'text', m.content))",
    ),
    Layout(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        "transform(conversations, m -> named_struct('role', "
        + _named_roles("m.`from`")
        + ", 'text', m.value))",
    ),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Layout(
        "instruction",
        ("instruction", "output"),
        _pair("concat_ws('\\n\\n', instruction, nullif({input}, ''))", "output"),
        ("input",),
    ),
)


def field_paths(schema: T.StructType) -> dict[str, str]:
    """Nested paths of the text fields of a schema, each with SQL that tells if it holds a value."""
    paths = {}

    def walk(kind: T.DataType, path: str, present) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(
                    f.dataType,
                    f"{path}.{f.name}" if path else f.name,
                    lambda test, f=f, above=present: above(
                        lambda row: test(f"{row}.`{f.name}`" if row else f"`{f.name}`")
                    ),
                )
        elif isinstance(kind, T.ArrayType):
            name = f"x{path.count('[]')}"
            walk(
                kind.elementType,
                f"{path}[]",
                lambda test, above=present: above(
                    lambda row: f"exists({row}, {name} -> {test(name)})"
                ),
            )
        else:
            paths[path] = present(lambda row: f"{row} IS NOT NULL")

    walk(schema, "", lambda test: test(""))
    return paths


def fingerprint(schema: T.StructType) -> Column:
    """Hash of the sorted field paths in which a record holds a value."""
    found = [
        F.expr(f"CASE WHEN {test} THEN '{path}' END")
        for path, test in sorted(field_paths(schema).items())
    ]
    return F.xxhash64(F.concat_ws(" ", *found)) if found else F.lit(0).cast("long")


def canonical_turns(records: DataFrame, id_column: str, layouts=LAYOUTS) -> DataFrame:
    """`id, layout, turns` of records whose other columns are the fields of their layouts.

    Layouts that need a field which the table has not cannot occur in it and are skipped.
    """
    schema = T.StructType([f for f in records.schema.fields if f.name != id_column])
    known = set(field_paths(schema))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for option in layouts:
        if not set(option.needs) <= known:
            continue
        sql = option.turns.replace("{input}", "input" if "input" in known else "CAST(NULL AS STRING)")
        matches = F.col("_fingerprint").isin(
            *(F.xxhash64(F.lit(paths)) for paths in option.path_sets())
        )
        layout = F.when(matches, F.lit(option.name)).otherwise(layout)
        turns = F.when(matches, F.expr(sql).cast(TURNS)).otherwise(turns)
    marked = records.withColumn("_fingerprint", fingerprint(schema))
    return marked.select(
        F.col(id_column).alias("id"), layout.alias("layout"), turns.alias("turns")
    )


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(~*)\|", "<$1~|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)~\|", "<$1|")


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escaped_role(role: Column) -> Column:
    return _replaced(escaped(role), ("%", "%25"), ("\n", "%0A"))


def unescaped_role(role: Column) -> Column:
    return unescaped(_replaced(role, ("%0A", "\n"), ("%25", "%")))


def formatted(records: DataFrame) -> DataFrame:
    """Add `text` and `loss` to `id, layout, turns`.

    `loss` has one (head, length) per turn: how many characters of the turn's block
    precede its text, and how many of the text are trained on (0 but for assistants).
    """

    def block(t: Column) -> Column:
        return F.concat(
            F.lit(START), escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END)
        )

    def mask(t: Column) -> Column:
        head = F.length(escaped_role(t["role"])) + len(START) + 1
        length = F.when(t["role"] == "assistant", F.length(escaped(t["text"]))).otherwise(0)
        return F.struct(head.alias("head"), F.coalesce(length, F.lit(0)).alias("length"))

    return records.withColumns(
        {
            "text": F.array_join(F.transform("turns", block), ""),
            "loss": F.transform("turns", mask),
        }
    )


def read_back(chats: DataFrame) -> DataFrame:
    """`id, turns, loss_text` recovered from `id, text, loss` alone."""
    blocks = F.filter(F.split("text", START.replace("|", r"\|")), lambda b: b != "")

    def turn(b: Column) -> Column:
        role = F.substring_index(b, "\n", 1)
        begin = F.length(role) + 2
        length = F.length(b) - begin + 1 - len(END)
        return F.struct(
            unescaped_role(role).alias("role"), unescaped(F.substring(b, begin, length)).alias("text")
        )

    def trained(b: Column, m: Column) -> Column:
        return unescaped(F.substring(b, m["head"] - len(START) + 1, m["length"]))

    return chats.withColumn("_blocks", blocks).select(
        "id",
        F.transform("_blocks", turn).alias("turns"),
        F.array_join(F.zip_with("_blocks", "loss", trained), "").alias("loss_text"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def records_by_turn(rows: DataFrame) -> DataFrame:
    """Records of the `messages` layout from rows of `conv_id, turn, role, text`."""
    empty = F.lit("")
    message = F.struct(
        "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    )
    return rows.groupBy("conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(message)),
            lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")),
        ).alias("messages")
    )


def chat_digests(rows: DataFrame) -> DataFrame:
    """Format conversations given as rows by turn, and digest what is read back from the output."""
    chats = formatted(canonical_turns(records_by_turn(rows), "conv_id"))
    back = read_back(chats)
    line = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return back.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
