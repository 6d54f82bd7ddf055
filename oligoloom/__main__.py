import sys

from oligoloom.cli import main

sys.exit(main())
