"""Result tables and nested documents."""
