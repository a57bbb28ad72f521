"""python -m brindle [NAME DIR [OUT]]: lists the queries, or runs one over the tables in DIR and shows or writes it."""

import sys

from brindle.plans import QUERIES
from brindle.plans.session import session


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print(__doc__)
        for name, f in sorted(QUERIES.items()):
            print(f"  {name}: {(f.__doc__ or f.__module__).splitlines()[0]}")
        return 0 if not args else 2
    df = QUERIES[args[0]](session(), args[1])
    if len(args) > 2:
        df.write.mode("overwrite").parquet(args[2])
    else:
        df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
