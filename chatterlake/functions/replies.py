"""Model requests and replies: building request JSON, reading reply JSON, parsing label and score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterlake.functions import fixed_values as fv
from chatterlake.functions.text import col, strip
from chatterlake.functions.tokens import let


# --- rounding ---------------------------------------------------------------------------------
def round2(v: Column) -> Column:
    """Two decimals of the exact binary value, ties to even: what ``f"{v:.2f}"`` gives.

    ``bround`` works on the shortest decimal form, so it only differs where that form ends in a
    third-decimal 5 that the binary value misses slightly.  Those values are decided by the sign of
    the exact error of ``v * 1000``, found by splitting ``v`` into two halves of 26 bits.
    """
    n = F.rint(v * 1000.0)
    third_is_five = (v == n / 1000.0) & (F.abs(n) % 10.0 == 5.0)

    def decide(x: Column) -> Column:
        n = F.rint(x * 1000.0)
        scaled = x * 134217729.0
        high = scaled - (scaled - x)
        side = F.signum(((high * 1000.0 - n) + (x - high) * 1000.0) * F.signum(n))
        return F.when(side == 0.0, F.bround(x, 2)).otherwise(F.rint((n + F.signum(n) * side * 5.0) / 10.0) / 100.0)

    return F.when(third_is_five, decide(v)).otherwise(F.bround(v, 2))


# --- replies ----------------------------------------------------------------------------------
def drop_think(c: Column | str) -> Column:
    """Remove ``<think>`` blocks (shortest match, across lines) and strip."""
    c = col(c)
    return strip(F.when(c.contains("<think>"), F.regexp_replace(c, fv.THINK_BLOCK, "")).otherwise(c))


def python_float(c: Column) -> Column:
    """The number Python's ``float()`` reads from a stripped text, or null."""
    digits = F.regexp_replace(c, "_", "")
    return F.when(c.rlike(fv.FLOAT_LITERAL), digits.try_cast("double"))


def _label_and_value(text: Column) -> Column:
    """label and number of a reply of the form ``label,number``."""
    return let(
        F.split(text, ",", 2),
        lambda parts: F.struct(
            F.lower(strip(F.get(parts, F.lit(0)))).alias("label"),
            let(strip(F.get(parts, F.lit(1))), python_float).alias("value"),
        ),
    )


def _result(label: Column, score: Column) -> Column:
    return F.struct(label.alias("sentiment"), score.alias("score"))


def parse_local(reply: Column | str) -> Column:
    """struct<sentiment, score> on the scale 0..1; (unknown, 0.0) when the reply is not usable.

    First a labelled score anywhere in the reply, then the whole reply as ``label,number``.
    """
    pattern = "(?iU)" + fv.LABEL_AND_SCORE
    unknown = _result(F.lit(fv.UNKNOWN), F.lit(0.0))

    def whole(pair: Column) -> Column:
        usable = pair.label.isin(*fv.LABELS) & pair.value.between(0.0, 1.0)
        return F.when(usable, _result(pair.label, F.abs(round2(pair.value)))).otherwise(unknown)

    def parse(text: Column) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        score = F.regexp_extract(text, pattern, 2).try_cast("double")
        return F.when(found != "", _result(F.lower(found), score)).otherwise(
            let(_label_and_value(text), whole)
        )

    return let(F.coalesce(drop_think(reply), F.lit("")), parse)


def parse_remote(reply: Column | str) -> Column:
    """struct<sentiment, score> on the scale -1..1; (neutral, 0.0) when the reply is not usable.

    Scores outside the scale are clamped; NaN counts as above it.
    """
    neutral = _result(F.lit("neutral"), F.lit(0.0))

    def whole(pair: Column) -> Column:
        clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pair.value))
        usable = pair.label.isin(*fv.LABELS) & pair.value.isNotNull()
        return F.when(usable, _result(pair.label, let(clamped, round2))).otherwise(neutral)

    text = F.lower(F.coalesce(drop_think(reply), F.lit("")))
    return let(let(text, _label_and_value), whole)


# --- JSON bodies ------------------------------------------------------------------------------
def reply_text(body: Column | str) -> Column:
    """Text of a chat reply: ``message.content`` if there is a message, else the first choice."""
    body = col(body)
    has_message = F.get_json_object(body, "$.message").isNotNull()
    content = F.when(has_message, F.get_json_object(body, "$.message.content")).otherwise(
        F.get_json_object(body, "$.choices[0].message.content")
    )
    return strip(F.coalesce(content, F.lit("")))


def first_choice_text(body: Column | str) -> Column:
    """Serial form: only the first choice is read."""
    content = F.get_json_object(col(body), "$.choices[0].message.content")
    return strip(F.coalesce(content, F.lit("")))


def _error(kind: str, message: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"))


def _content_error(message: Column, may_be_null: bool) -> Column:
    """What is wrong with a message: not an object, without content, or with a null one."""
    keys = F.json_object_keys(message)
    null = F.get_json_object(message, "$.content").isNull()
    found = F.when(keys.isNull(), _error("TypeError", "the message is no object")).when(
        ~F.array_contains(keys, "content"), _error("KeyError", "'content'")
    )
    return found if may_be_null else found.when(null, _error("AttributeError", "the content is null"))


def _choice_error(body: Column, may_be_null: bool) -> Column:
    choices, first = F.get_json_object(body, "$.choices"), F.get_json_object(body, "$.choices[0]")
    keys = F.json_object_keys(first)
    return (
        F.when(F.json_array_length(choices).isNull(), _error("TypeError", "the choices are no list"))
        .when(F.json_array_length(choices) == 0, _error("IndexError", "list index out of range"))
        .when(keys.isNull(), _error("TypeError", "the choice is no object"))
        .when(~F.array_contains(keys, "message"), _error("KeyError", "'message'"))
        .otherwise(_content_error(F.get_json_object(first, "$.message"), may_be_null))
    )


def broken_reply(body: Column | str) -> Column:
    """struct<type, message> of what keeps ``reply_text`` from reading a body, null if nothing does.

    A null body is no reply at all, and an object without message and choices an empty one.
    """
    body = col(body)
    keys = F.json_object_keys(body)
    return (
        F.when(body.isNull(), None)
        .when(keys.isNull(), _error("JSONDecodeError", "the reply is no JSON object"))
        .when(F.array_contains(keys, "message"), _content_error(F.get_json_object(body, "$.message"), True))
        .when(F.array_contains(keys, "choices"), _choice_error(body, True))
    )


def broken_choice(body: Column | str) -> Column:
    """The same for ``first_choice_text``, which needs a first choice with content."""
    body = col(body)
    keys = F.json_object_keys(body)
    return (
        F.when(body.isNull(), None)
        .when(keys.isNull(), _error("JSONDecodeError", "the reply is no JSON object"))
        .when(~F.array_contains(keys, "choices"), _error("KeyError", "'choices'"))
        .otherwise(_choice_error(body, False))
    )


def chat_request(
    model: str, system: str, user: Column | str, **options: float | int | bool | dict
) -> Column:
    """Request JSON: model, system and user message, then the options in the given order.

    Null text is sent as the empty string.
    """
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(
        message("system", F.lit(system)), message("user", F.coalesce(col(user), F.lit("")))
    )
    extra = [
        (F.create_map().cast("map<string,string>") if v == {} else F.lit(v)).alias(k)
        for k, v in options.items()
    ]
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"), *extra))


# --- failures ---------------------------------------------------------------------------------
def failed_marker(error_type: Column | str, message: Column | str, form: str = "concurrent") -> Column:
    """Marker stored in place of a translation that failed; it is not blank, so it counts as done."""
    cut = fv.FAILED_MESSAGE_CHARS[form]
    return F.concat(
        F.lit(fv.FAILED_PREFIX), col(error_type), F.lit("] "), F.substring(col(message), 1, cut)
    )


def is_failed(c: Column | str) -> Column:
    return F.coalesce(col(c).startswith(fv.FAILED_PREFIX), F.lit(False))
