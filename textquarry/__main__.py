from .plans.rpc import main

raise SystemExit(main())
