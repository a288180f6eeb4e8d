"""An agent that answers with tools, and the chat it belongs to. The model and the tools are injected; their results are texts."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Tool = Callable[[dict], str]


@dataclass
class Answer:
    text: str
    calls: list[tuple[str, dict]] = field(default_factory=list)
    forced: bool = False


def trimmed(text: str, budget: int, count: Callable[[str], int]) -> str:
    """The longest beginning of whole lines within the budget; a first line that is too long is cut by words."""
    used, kept = 0, []
    for line in text.splitlines():
        n = count(line)
        if used + n > budget:
            if not kept:
                words = line.split(" ")
                while words and count(" ".join(words)) > budget:
                    words = words[: len(words) * budget // max(count(" ".join(words)), budget + 1)]
                kept.append(" ".join(words))
            break
        kept.append(line)
        used += n
    return "\n".join(kept)


def run_agent(question: str, model: Callable[[list[dict]], str], tools: dict[str, Tool], turns: int = 3, budget: int = 30_000, count: Callable[[str], int] = lambda x: len(x.split())) -> Answer:
    """One tool per turn: the model replies with JSON, {"tool": name, "arguments": {...}} or {"answer": text}; a reply that is no such JSON is the answer.
    After the last turn it is asked for an answer without tools. Tool results are trimmed so that all together stay within the budget; a tool that is
    unknown or fails is reported to the model."""
    messages = [{"role": "user", "content": question}]
    out, left = Answer(""), budget
    for _ in range(turns):
        reply = model(messages)
        try:
            asked = json.loads(reply)
        except ValueError:
            asked = None
        if not isinstance(asked, dict) or "tool" not in asked:
            out.text = str(asked["answer"]) if isinstance(asked, dict) and "answer" in asked else reply
            return out
        name, arguments = asked["tool"], asked.get("arguments") or {}
        out.calls.append((name, arguments))
        try:
            found = tools[name](arguments) if name in tools else f"There is no tool {name}."
        except Exception as e:  # noqa: BLE001 - the model is told and may try something else
            found = f"{type(e).__name__}: {e}"
        found = trimmed(found, left, count)
        left -= count(found)
        messages += [{"role": "assistant", "content": reply}, {"role": "tool", "content": found}]
    messages.append({"role": "user", "content": "Answer now, without tools."})
    out.text, out.forced = model(messages), True
    return out


# chat: sessions (session, title, updated), messages (session, position, role, text)


def add_message(sessions: DataFrame, messages: DataFrame, session: str, role: str, text: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with a message at the end of a session, which is made if it isn't there."""
    spark = messages.sparkSession
    last = messages.where(F.col("session") == session).agg(F.coalesce(F.max("position"), F.lit(-1)) + 1).first()[0]
    new = spark.createDataFrame([(session, int(last), role, text)], "session string, position int, role string, text string")
    own = sessions.where(F.col("session") == session).withColumn("updated", F.lit(at))
    if own.isEmpty():
        own = spark.createDataFrame([(session, text[:60], at)], "session string, title string, updated string")
    return sessions.where(F.col("session") != session).unionByName(own), messages.unionByName(new)


def delete_session(sessions: DataFrame, messages: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    return sessions.where(F.col("session") != session), messages.where(F.col("session") != session)


def list_sessions(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Sessions, the last updated first, with how many messages they have."""
    n = messages.groupBy("session").agg(F.count("*").alias("messages"))
    return sessions.join(n, "session", "left").withColumn("messages", F.coalesce("messages", F.lit(0))).orderBy(F.desc("updated"), "session").limit(limit)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of every session; read them by position."""
    w = Window.partitionBy("session").orderBy(F.desc("position"))
    return messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
