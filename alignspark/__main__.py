"""``python -m alignspark --version``."""

import sys

from alignspark import __version__

if __name__ == "__main__":
    if sys.argv[1:] == ["--version"]:
        print(__version__)
    else:
        sys.exit("usage: python -m alignspark --version")
