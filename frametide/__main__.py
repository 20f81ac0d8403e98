from frametide.cli import main

raise SystemExit(main())
