import sys

from strandweave.plans.cli import main

sys.exit(main())
