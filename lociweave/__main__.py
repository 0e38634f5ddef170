"""python -m lociweave."""

from .cli import main

main()
