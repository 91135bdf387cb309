"""Table profiling and statistical insight as plain DataFrame functions."""
