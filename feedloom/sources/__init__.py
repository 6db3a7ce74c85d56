"""Where rows come from: pages, node tables, feed documents, HTTP."""
