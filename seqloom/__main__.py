"""python -m seqloom"""

from .cli import main

main()
