"""Where rows come from: tables with a schema, and text files with a header."""
