"""plinth.sinks"""
