"""Command lines: python -m webloom recompress | index | check | extract | text | benchmark."""

from webloom.cli import main

raise SystemExit(main())
