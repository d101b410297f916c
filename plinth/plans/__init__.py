"""plinth.plans"""
