"""A person's verdicts from the command line: ``python -m claimgraph.cli VERB --store PATH ...``.

Exit status: 0 done, 1 refused (the reason is printed), 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from claimgraph.schema import CLOSE_REASONS, RETIRE_REASONS
from claimgraph.store import Keeper, KnowledgeStore, Ledger, Refused


def reasons(names: tuple[str, ...]) -> dict[str, str]:
    """Reasons as they are typed: words in lower case, joined by hyphens."""
    return {"".join(f"-{c.lower()}" if c.isupper() else c for c in n).lstrip("-"): n for n in names}


RETIRE, CLOSE = reasons(RETIRE_REASONS), reasons(CLOSE_REASONS[:-1])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="claimgraph", description="Render a person's verdict on a store.")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, told: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=told)
        v.add_argument("--store", required=True, help="folder of the store")
        if name != "pending":
            v.add_argument("--as", dest="author", required=True, help="who rules; recorded as asserted")
            v.add_argument("--why", required=True, help="the rationale")
            v.add_argument("record")
        return v

    verb("pending", "list the proposals that wait for a verdict")
    verb("promote", "accept a claim").add_argument("--retiring", help="a promoted claim that this one replaces")
    verb("reject", "refuse a claim")
    verb("retire", "end a promoted claim").add_argument("--reason", required=True, choices=RETIRE)
    verb("withdraw", "close an open question without an answer").add_argument("--reason", required=True, choices=CLOSE)
    verb("answer", "close an open question with a promoted claim").add_argument("--with", dest="claim", required=True)
    verb("score", "settle a hypothesis").add_argument("--outcome", required=True)
    verb("abandon", "give a hypothesis up").add_argument("--reason", required=True, choices=CLOSE)
    return p


def run(args: argparse.Namespace, ledger: Ledger) -> list[str]:
    if args.verb == "pending":
        rows = KnowledgeStore(ledger).pending_proposals(200).collect()
        return [f"{r['record_id']} {r['queue']}" + (f" {r['head']}" if r["head"] else "") for r in rows]
    keeper, record, why = Keeper(ledger, args.author), args.record, args.why
    done = {
        "promote": lambda: keeper.promote(record, args.retiring, why),
        "reject": lambda: keeper.reject(record, why),
        "retire": lambda: keeper.retire(record, RETIRE[args.reason], why),
        "withdraw": lambda: keeper.withdraw(record, CLOSE[args.reason], why),
        "answer": lambda: keeper.answer(record, args.claim, why),
        "score": lambda: keeper.score(record, args.outcome, why),
        "abandon": lambda: keeper.abandon(record, CLOSE[args.reason], why),
    }[args.verb]()
    return [done]


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from claimgraph.session import get_spark

        spark = get_spark("local[2]", 4)
    try:
        for line in run(args, Ledger(spark, args.store, read_only=args.verb == "pending")):
            print(line)
    except Refused as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
