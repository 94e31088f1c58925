import sys

from .plans.pipeline import main

sys.exit(main(sys.argv[1:]))
