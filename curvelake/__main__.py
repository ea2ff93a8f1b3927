"""Entry of ``python -m curvelake``."""

from curvelake.cli import main

raise SystemExit(main())
