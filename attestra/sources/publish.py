"""Publishing one file with its receipt and index entry as a transaction on the driver, and recovery after a crash.

The intent is written before anything else. Every later step asks what is on disk and does only what is missing, so
publishing and recovery share one function: a crash between steps is mended by running the steps again.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from attestra.sources.vault import atomic_json, atomic_write

CLOSED = ("committed", "discarded")


class Conflict(ValueError):
    """What is on disk contradicts the transaction; the intent stays for manual reconciliation."""


def digest(path: str) -> str:
    """Hash of a file's bytes, ``missing`` without a file."""
    if not os.path.isfile(path):
        return "missing"
    with open(path, "rb") as f:
        return "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()


def _load(path: str, default=None):
    if not os.path.isfile(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@contextmanager
def exclusive(root: str, wait: float = 10.0) -> Iterator[None]:
    """The ledger's lock, held by the kernel for this process; a dead holder releases it. Busy beyond ``wait`` seconds is an error."""
    os.makedirs(root, exist_ok=True)
    until = time.monotonic() + wait
    with open(f"{root}/.ledger.lock", "a") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= until:
                    raise ValueError("ledger_lock_busy") from None
                time.sleep(0.05)
        yield  # closing the file releases the lock


def _finish(folder: str, at: Callable[[str], None]) -> str:
    """Bring a transaction to its end: ``committed``, or ``discarded`` if its file never appeared."""
    intent = _load(f"{folder}/intent.json")
    if intent["state"] in CLOSED:
        return intent["state"]

    def close(state: str) -> str:
        atomic_json(f"{folder}/intent.json", intent | {"state": state})
        return state

    def refuse(problem: str) -> None:
        close("conflict")
        raise Conflict(problem)

    if intent["state"] == "conflict":
        raise Conflict("needs_reconciliation")
    receipt = intent["receipt"] | {"validation_result": "committed"}
    there, written = digest(intent["target"]), _load(intent["receipt_path"])
    if there == "missing":
        return refuse("receipt_without_asset") if written else close("discarded")
    if there != intent["hash"]:
        refuse("target_modified")
    if written is not None and written != receipt:
        refuse("receipt_differs")
    index = _load(intent["index_path"], {"publications": []})
    mine = [p for p in index["publications"] if p.get("transaction_id") == intent["id"]]
    if not mine and digest(intent["index_path"]) != intent["index_before"]:
        refuse("index_changed")
    if mine and mine != [intent["item"]]:
        refuse("index_item_differs")
    if written is None:
        atomic_json(intent["receipt_path"], receipt)
    at("receipt")
    if not mine:
        atomic_json(intent["index_path"], index | {"publications": [*index["publications"], intent["item"]]})
    at("index")
    return close("committed")


def publish(root: str, vault: str, target: str, body: bytes, receipt: dict, item: dict, index_path: str, at: Callable[[str], None] = lambda step: None) -> str:
    """Publish ``body`` at ``target``: the file, then its receipt, then its index entry. Returns ``committed``.

    The target and receipt must be new and lie below ``vault`` and ``root``. A file that appears at the target meanwhile is never
    overwritten. A discarded transaction of the same id is kept beside and tried anew; an open one must be recovered first.
    ``at`` is called after each step (tests raise there). Use below ``exclusive``.
    """
    name = receipt["transaction_id"]
    if "/" in name or not os.path.realpath(target).startswith(os.path.realpath(vault) + os.sep):
        raise ValueError("target_outside_vault")
    folder, receipt_path = f"{root}/transactions/{name}", f"{root}/receipts/{name}.json"
    old = _load(f"{folder}/intent.json")
    if old is not None and old["state"] == "discarded":
        os.replace(folder, f"{folder}.discarded-{time.time_ns()}")
    elif old is not None or os.path.exists(target) or os.path.exists(receipt_path):
        raise Conflict("predecessor_exists")
    staged = f"{folder}/body"
    intent = {
        "id": name, "state": "open", "target": target, "hash": "sha256:" + hashlib.sha256(body).hexdigest(), "receipt": receipt, "receipt_path": receipt_path,
        "item": item | {"transaction_id": name}, "index_path": index_path, "index_before": digest(index_path),
    }
    atomic_json(f"{folder}/intent.json", intent)
    at("intent")
    atomic_write(staged, body)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        os.link(staged, target)  # fails if the target exists
    except FileExistsError:
        atomic_json(f"{folder}/intent.json", intent | {"state": "conflict"})
        raise Conflict("target_appeared") from None
    at("asset")
    return _finish(folder, at)


def recover(root: str, at: Callable[[str], None] = lambda step: None) -> dict[str, str]:
    """Transaction id -> outcome of every open transaction; one in conflict is reported and doesn't stop the others."""
    out: dict[str, str] = {}
    for name in sorted(os.listdir(f"{root}/transactions")) if os.path.isdir(f"{root}/transactions") else []:
        intent = _load(f"{root}/transactions/{name}/intent.json")
        if intent is None or intent["state"] in CLOSED:
            continue
        try:
            out[name] = _finish(f"{root}/transactions/{name}", at)
        except Conflict as e:
            out[name] = f"conflict: {e}"
    return out
